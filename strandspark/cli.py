"""Command line: ``python -m strandspark.cli assemble|report|check|majority …``."""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions import scoring
from .operators import pileup
from .plans import assemble, contamination, report
from .sources import readers, writers

FORMATS = ("1", "2", "3", "4", "41", "5", "6", "61", "7")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandspark")
    sub = top.add_subparsers(dest="command", required=True)

    a = sub.add_parser("assemble", add_help=False, help="align reads, call a consensus, repeat")
    a.add_argument("--help", action="help")
    a.add_argument("-r", "--reference", required=True)
    a.add_argument("-f", "--reads", required=True)
    a.add_argument("-s", "--matrix")
    a.add_argument("--matrix-dir", action="append", default=[])
    a.add_argument("-m", "--root", default="assembly.iter")
    a.add_argument("-u", dest="by_score", action="store_true")
    a.add_argument("-U", dest="by_quality", action="store_true")
    a.add_argument("-A", dest="adapter_aware", action="store_true")
    a.add_argument("-C", dest="collapse", nargs="?", const=0, type=int)
    a.add_argument("-T", dest="trim", action="store_true")
    a.add_argument("-a", dest="adapter", default="n")
    a.add_argument("-k", dest="kmer", type=int)
    a.add_argument("-M", dest="soft_mask", action="store_true")
    a.add_argument("-I", dest="ids")
    a.add_argument("-p", dest="cons_code", type=int, default=1)
    a.add_argument("-c", dest="circular", action="store_true")
    a.add_argument("-i", dest="iterate", action="store_true", default=True)
    a.add_argument("-n", dest="iterate", action="store_false")
    a.add_argument("-F", dest="final_only", action="store_true")
    a.add_argument("-D", dest="distant", action="store_true")
    a.add_argument("-h", dest="homopolymer", action="store_true")
    a.add_argument("-H", dest="hard_cut", type=int)
    a.add_argument("-S", dest="slope", type=float)
    a.add_argument("-N", dest="intercept", type=float)
    a.add_argument("-q", dest="fastq")

    m = sub.add_parser("report", help="print a saved assembly")
    m.add_argument("-M", "--assembly", required=True)
    m.add_argument("-c", dest="cons_code", type=int)
    m.add_argument("-f", dest="format", choices=FORMATS, default="1")
    m.add_argument("-R", dest="region", default="90:109")
    m.add_argument("-I", dest="name")
    m.add_argument("-C", dest="colour", action="store_true")
    m.add_argument("-m", dest="save")
    m.add_argument("-i", dest="ids")
    m.add_argument("-s", dest="slope", type=float)
    m.add_argument("-b", dest="intercept", type=float)
    m.add_argument("-d", dest="no_duplicates", action="store_true")

    c = sub.add_parser("check", help="look for a contaminant in saved assemblies")
    c.add_argument("assemblies", nargs="+")
    c.add_argument("-r", "--reference", help="the contaminant, a FASTA file; by default the one that the session's spark.strandspark.contaminant names")
    c.add_argument("-a", "--ancient", action="store_true")
    c.add_argument("-t", "--transversions", action="store_true")
    c.add_argument("-s", "--span")
    c.add_argument("-n", "--numpos", type=int, default=1)
    c.add_argument("-d", "--maxd", type=int)
    c.add_argument("-f", "--this-file", action="store_true", help="do not look for a newer file")
    c.add_argument("-T", "--table", action="store_true")
    c.add_argument("-F", "--force", "--shoot", "--foot", action="store_true")
    c.add_argument("-v", "--verbose", action="count", default=0)
    c.add_argument("-M", dest="ignored", action="store_true")

    j = sub.add_parser("majority", help="per cent majority consensus of aligned FASTA files")
    j.add_argument("files", nargs="+")
    j.add_argument("-p", "--percent", type=int, default=100)
    style = j.add_mutually_exclusive_group()
    style.add_argument("-n", dest="style", action="store_const", const="strict")
    style.add_argument("-i", dest="style", action="store_const", const="iupac")
    style.add_argument("-g", dest="style", action="store_const", const="gaps")
    j.add_argument("-o", "--output")
    j.set_defaults(style="gaps")
    return top


def region(text: str) -> tuple[int, int]:
    found = re.fullmatch(r"(\d+):(\d+)", text)
    if not found:
        raise ValueError("a region is first:last")
    low, high = sorted(map(int, found.groups()))
    return low, high


def _settings(o: argparse.Namespace) -> Settings:
    if o.hard_cut is not None and o.hard_cut <= 0:
        raise ValueError("the hard cut must be above zero")
    line = {"slope": o.slope, "intercept": o.intercept}
    if o.slope is not None or o.intercept is not None:
        line = {"slope": 200.0 if o.slope is None else o.slope, "intercept": 0.0 if o.intercept is None else o.intercept}
    return Settings(
        kmer=o.kmer, soft_mask=o.soft_mask, circular=o.circular, distant=o.distant, homopolymer=o.homopolymer, iterate=o.iterate, cons_code=o.cons_code,
        dedup="quality" if o.by_quality else "score" if o.by_score else None, adapter_aware=o.adapter_aware, tolerance=o.collapse or 0, collapse=o.collapse is not None,
        trim=o.trim, adapter=o.adapter, hard_cut=o.hard_cut or 0, **line,
    )


def save(done: assemble.Assembly, path: str) -> None:
    """Parquet for the placed reads and the text form beside it."""
    gaps = {r["pos"]: r["gap"] for r in pileup.gap_lengths(done.alns).collect()}
    cols = [c.split(" ")[0] for c in readers.ALNS.split(", ")]
    alns = done.alns.select(*cols)
    alns.write.mode("overwrite").parquet(f"{path}.parquet")
    text = writers.assembly_lines(done.name, "", done.reference, [gaps.get(k, 0) for k in range(len(done.reference))], done.forward, done.backward, alns, done.settings.cons_code)
    text.write.mode("overwrite").text(path)


def run_assemble(spark: SparkSession, o: argparse.Namespace) -> assemble.Assembly:
    settings = _settings(o)
    name, _, ref = readers.reference(spark, o.reference, settings)
    reads = readers.reads(spark, o.reads, settings)
    if o.ids:
        reads = readers.only_listed(reads, readers.id_list(spark, o.ids, settings))
    matrix = None
    if o.matrix:
        with open(scoring.find(o.matrix, o.matrix_dir)) as f:
            matrix = scoring.parse(f.read(), settings)
    each = None if o.final_only else lambda d: save(d, f"{o.root}.{d.rounds}")
    done = assemble.assemble(spark, reads, ref, name, matrix, settings, each)
    if o.final_only:
        save(done, f"{o.root}.{done.rounds}")
    if o.fastq:
        rows = done.alns.filter("segment <> 'b'").select("ord", "id", F.col("read").alias("seq"), "qual", "rc", "trimmed")
        writers.write_lines(writers.fastq_lines(rows), o.fastq)
    return done


def load(spark: SparkSession, path: str) -> assemble.Assembly:
    head, alns = readers.assembly_text(spark, path)
    import numpy as np

    forward, backward = (np.asarray(head[k]).reshape(-1, 5, 5) for k in ("forward", "backward"))
    settings = Settings(cons_code=int(head.get("maln_coc", 1)))
    return assemble.Assembly(head["id"], head["seq"], alns, forward, backward, settings=settings)


def run_report(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    if (o.slope is None) != (o.intercept is None):
        raise ValueError("slope and intercept come together")
    done = load(spark, o.assembly)
    done.name = o.name or done.name
    columns = report.called(done, o.cons_code)
    low, high = region(o.region)
    text = {
        "1": lambda: report.clustal(columns, done.name).orderBy("block").select("value"),
        "2": lambda: report.line(columns),
        "3": lambda: report.table(columns, done.alns).orderBy("pos", "place").drop("place"),
        "4": lambda: report.details(columns).orderBy("pos", "ins_idx"),
        "41": lambda: report.details(columns, False).orderBy("pos", "ins_idx"),
        "5": lambda: report.fasta(columns),
        "6": lambda: report.region(done, low, high, colour=o.colour).select("value"),
        "61": lambda: report.region(done, low, high, fasta_style=True).select("value"),
        "7": lambda: report.ace(done),
    }[o.format]()
    if o.save:
        save(done, o.save)
    return text


def run_check(spark: SparkSession, o: argparse.Namespace) -> list[contamination.Check]:
    path = o.reference or spark.conf.get("spark.strandspark.contaminant", None)
    if not path:
        raise ValueError("name a contaminant, or set spark.strandspark.contaminant")
    _, _, other = readers.reference(spark, path)
    span = None
    if o.span:
        low, high = (int(x) for x in o.span.split("-"))
        span = (low, high)
    out = []
    for path in o.assemblies:
        done = load(spark, path if o.this_file else readers.newest(spark, path))
        out.append(contamination.check(spark, done.alns, done.reference, other, o.ancient, span, o.numpos, o.maxd, o.force, o.transversions))
    return out


def run_majority(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    rows = None
    for path in o.files:
        one = readers.fasta(spark, path, longest=0).select("seq")
        rows = one if rows is None else rows.unionByName(one)
    chars = F.filter(F.split("seq", ""), lambda c: c != "")
    called = pileup.majority(rows.select(F.posexplode(chars).alias("pos", "base")), o.percent, o.style)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "")
    return called.agg(text.alias("seq")).select(writers.fasta_record(F.lit("consensus"), F.col("seq")).alias("value"))


def main(args: list[str] | None = None) -> int:
    o = parser().parse_args(args)
    spark = SparkSession.builder.appName("strandspark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if o.command == "assemble":
        done = run_assemble(spark, o)
        print(f"{done.rounds} rounds, consensus of {len(done.consensus)} bases")
    elif o.command == "report":
        df = run_report(spark, o)
        # A report is as long as a reference; rows are streamed, not gathered.
        for row in df.toLocalIterator():
            print("\t".join("" if x is None else str(x) for x in row))
    elif o.command == "check":
        for path, found in zip(o.assemblies, run_check(spark, o), strict=True):
            for name, df in (("strong", found.strong), ("all", found.both)):
                row = df.first().asDict()
                if o.table:
                    print("\t".join([os.path.basename(path), name, str(found.distance), *map(str, row.values())]))
                else:
                    print(f"{path}, {name} positions (distance {found.distance}): " + ", ".join(f"{k} {v}" for k, v in row.items()))
    else:
        text = run_majority(spark, o).first()["value"]
        if o.output:
            with open(o.output, "w") as f:
                f.write(text + "\n")
        else:
            print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
