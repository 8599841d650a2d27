"""The four commands, from files to files."""

import random

from strandspark import cli
from strandspark.operators.align import flip


def test_commands(spark, tmp_path):
    rng = random.Random(12)
    truth = "".join(rng.choice("ACGT") for _ in range(300))
    other = "".join({"A": "C", "C": "A", "G": "T", "T": "G"}[c] if k % 6 == 1 else c for k, c in enumerate(truth))
    (tmp_path / "ref.fa").write_text(f">chr test\n{truth[:150].lower()}\n{truth[150:]}\n")
    (tmp_path / "other.fa").write_text(f">other\n{other}\n")
    reads = "".join(f"@r{k} x\n{flip(truth[s:s + 60]) if k % 2 else truth[s:s + 60]}\n+\n{'I' * 60}\n" for k, s in enumerate(range(0, 240, 6)))
    (tmp_path / "reads.fq").write_text(reads)
    (tmp_path / "ids").write_text("\n".join(f"r{k}" for k in range(0, 39)))
    root = str(tmp_path / "run.iter")
    o = cli.parser().parse_args(["assemble", "-r", str(tmp_path / "ref.fa"), "-f", str(tmp_path / "reads.fq"), "-m", root, "-k", "10", "-u", "-I", str(tmp_path / "ids"), "-H", "3000", "-q", str(tmp_path / "out.fq")])
    done = cli.run_assemble(spark, o)
    assert done.consensus == truth[:288] + "N" * 12
    assert spark.read.text(str(tmp_path / "out.fq")).filter("value LIKE '@r%'").count() == done.alns.count()
    saved = f"{root}.{done.rounds}"
    for fmt in cli.FORMATS:
        rows = cli.run_report(spark, cli.parser().parse_args(["report", "-M", saved, "-f", fmt, "-R", "60:40"])).collect()
        assert rows or fmt == "4"
    fasta = cli.run_report(spark, cli.parser().parse_args(["report", "-M", saved, "-f", "5"])).first()["value"]
    assert "".join(fasta.split("\n")[1:]) == done.consensus
    found = cli.run_check(spark, cli.parser().parse_args(["check", "-r", str(tmp_path / "other.fa"), "-d", "100", "-f", saved]))[0]
    row = found.strong.first()
    assert row.polluting == 0 and row.clean == done.alns.count()
    (tmp_path / "m.fa").write_text(">a\nAC-T\n>b\nAG-T\n>c\nAC-A\n")
    text = cli.run_majority(spark, cli.parser().parse_args(["majority", str(tmp_path / "m.fa"), "-p", "60"])).first()["value"]
    assert text == ">consensus\nACT"
