"""CSV with quoted line breaks read by many tasks equals the one-task multi-line scan."""
import random

from credence.sources import readers as R

SCHEMA = "id int, title string, body string, score double"


def write(path, n, seed=5):
    rng = random.Random(seed)
    words = ["alpha", "beta", 'say "hi"', "x,y", "line\nbreak", "two\n\nbreaks", "ünï", ""]
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write("id,title,body,score\n")
        for i in range(n):
            body = " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
            title = rng.choice(words)
            quote = lambda v: '"' + v.replace('"', '""') + '"'
            out.write(f"{i},{quote(title)},{quote(body)},{i / 7:.3f}\n")


def test_split_read_equals_multiline(spark, tmp_path):
    for n, name in ((3000, "a.csv"), (5, "b.csv")):
        write(tmp_path / name, n, seed=n)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        split = R.read_csv_split(spark, str(tmp_path), SCHEMA)
        assert split.rdd.getNumPartitions() >= 1
        got = sorted((tuple(r) for r in split.collect()), key=repr)
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = sorted((tuple(r) for r in R.read_csv(spark, str(tmp_path), SCHEMA).collect()), key=repr)
    assert tasks > 10 and len(got) == 3005 and got == want


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,title,body,score\n")
    assert R.read_csv_split(spark, str(tmp_path), SCHEMA).count() == 0
