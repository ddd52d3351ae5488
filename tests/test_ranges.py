"""A file read by ranges gives what one task reads, wherever the ranges are cut."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragauge.sources import delimited, ranges

THREE = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])


def written(seed: int, sep: str, n: int = 250) -> str:
    """Records with line ends, doubled quotes and separators in quotes, blank lines, short records."""
    rng = random.Random(seed)

    def field() -> str:
        kind = rng.randrange(7)
        plain = "".join(rng.choice("abc é") for _ in range(rng.randint(0, 9)))
        if kind < 3:
            return plain
        inner = "".join(rng.choice(["x", "\n", '""', sep, "\r\n", " ", "é"]) for _ in range(rng.randint(0, 14)))
        return f'"{inner}"'

    records = [sep.join(field() for _ in range(3)) for _ in range(n)]
    records[5] = "short"
    records[7:7] = ["", ""]
    records[60] = '"' + "long\n" * 300 + '"' + sep + "y" + sep + '""'  # over many ranges
    return sep.join("abc") + "\n" + "\n".join(r if r.strip() else "q" for r in records) + "\n"


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed,sep,size", [(1, "\t", 97), (2, ",", 700)])
def test_equals_the_read_by_one_task(spark, tmp_path, seed, sep, size):
    for k in range(2):
        (tmp_path / f"part-{k}.txt").write_bytes(written(seed + k, sep).encode())
    want = delimited.read_delimited(spark, str(tmp_path), THREE, sep)
    got = ranges.read_ranges(spark, str(tmp_path), THREE, sep, split_bytes=size, row_id="n")
    assert rows(got.drop("n")) == rows(want)
    one = [tuple(r) for k in range(2) for r in delimited.read_delimited(spark, str(tmp_path / f"part-{k}.txt"), THREE, sep).collect()]
    assert [tuple(r) for r in got.orderBy("n").select("a", "b", "c").collect()] == one
    assert [r.n for r in got.orderBy("n").collect()] == list(range(len(one)))


def test_many_ranges_are_joined_not_told(spark, tmp_path, monkeypatch):
    (tmp_path / "one.tsv").write_bytes(written(3, "\t").encode())
    want = rows(delimited.read_delimited(spark, str(tmp_path), THREE))
    monkeypatch.setattr(ranges, "TOLD_RANGES", 3)
    monkeypatch.setattr(delimited, "TOLD_SPLITS", 3)
    got = ranges.read_ranges(spark, str(tmp_path), THREE, split_bytes=150, row_id="n")
    assert rows(got.drop("n")) == want and got.agg(F.max("n")).scalar is not None


def test_rules_of_lines():
    outside, inside = ranges.line_rules(",")
    assert [bool(outside.match(x)) for x in ('a,"b', 'a,"b"', '"a""b', '"a"",b', 'a"b', '"a"x,"', "", '"', '""')] == [
        True, False, True, True, False, True, False, True, False,
    ]
    assert [bool(inside.match(x)) for x in ("abc", 'b"', 'b"",c', 'b",c', 'b","c', 'b"x"y,"z', "", '"', '""')] == [
        True, False, True, False, True, True, True, False, True,
    ]
    long = '"' + '""' * 200_000  # no recursion
    assert outside.match(long) and not outside.match(long + '"')


def test_states_follow_swaps_and_fixed_ranges(spark):
    """Against folding the ranges one by one."""
    rng = random.Random(4)
    given = [("f", 10 * k, *rng.choice([(0, 0), (1, 1), (0, 1), (1, 0)]), rng.random() < 0.5) for k in range(60)]
    given += [("g", k, 1, 0, True) for k in range(5)]
    want, last = {}, None
    for file, start, out, ins, touches in given:
        if file != last:
            state, owner, last = 0, None, file
        want[file, start] = (state, owner if state else None)
        if state == 0:
            state, owner = out, start if out else owner
        else:
            state, owner = ins, start if ins and touches else owner
    ends = spark.createDataFrame(given, ranges._ENDS).repartition(3)
    got = {(r.file, r.start): (r.inside, r.owner if r.inside else None) for r in ranges.range_states(ends).collect()}
    assert got == want


def test_empty_and_missing_parts(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("a\tb\tc\n")
    (tmp_path / "b.tsv").write_text("")
    (tmp_path / "c.tsv").write_text('a\tb\tc\n\n"NA"\t""\tNone')
    got = ranges.read_ranges(spark, str(tmp_path), THREE, na="pandas", row_id="n").collect()
    assert [tuple(r) for r in got] == [(0, None, None, None)]


def test_large_files_have_a_bounded_number_of_ranges(spark, tmp_path, monkeypatch):
    """Twice the file may not take twice the tasks for ever; the rows stay the same."""
    (tmp_path / "one.tsv").write_bytes(written(4, "\t", 3000).encode())
    want, counts, states = rows(delimited.read_delimited(spark, str(tmp_path), THREE)), [], ranges.range_states

    def counted(ends):
        counts.append(ends.count())
        return states(ends)

    monkeypatch.setattr(ranges, "range_states", counted)
    assert rows(ranges.read_ranges(spark, str(tmp_path), THREE, split_bytes=60)) == want
    assert 100 < counts[0] <= ranges.MOST_RANGES
