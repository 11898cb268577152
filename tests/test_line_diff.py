"""Line differences: applying the hunks gives the new text; anchors, repeated lines, edges, caps."""

import os
import random
from urllib.parse import unquote, urlparse

from pyspark.sql import functions as F

from tessera.operators import line_diff


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def edited(seed):
    dice = random.Random(seed)
    lines = [dice.choice(["}", "", "x = 1", f"line {dice.randrange(40)}"]) for _ in range(dice.randrange(60))]
    new = []
    for line in lines:
        act = dice.random()
        new += [] if act < 0.1 else [line, f"new {dice.randrange(9)}"] if act < 0.2 else [line.upper()] if act < 0.25 else [line]
    if dice.random() < 0.3:
        at = dice.randrange(len(new) + 1)
        new = new[at:] + new[:at]
    return "\n".join(lines), "\n".join(new)


CASES = {f"r{i}": edited(i) for i in range(40)} | {
    "same": ("a\nb\n", "a\nb\n"), "all": ("a\nb", "c\nd"), "empty": ("", "a\nb"), "emptied": ("a\nb", ""), "both empty": ("", ""), "added": (None, "x\ny"), "gone": ("x\ny", None),
    "newline": ("a", "a\n"), "swap": ("a\nb\nc", "c\na\nb"), "repeats": ("x\n" * 30, "x\n" * 20), "far": ("\n".join(f"l{i}" for i in range(200)), "\n".join(f"l{i}" if i not in (20, 24, 90) else "changed" for i in range(200))),
    "unicode": ("é b\r\nc", "é b\nc\U0001f600"),
}


def test_applying_the_hunks_gives_the_new_text(spark):
    old, new = files(spark, {p: a for p, (a, _) in CASES.items()}), files(spark, {p: b for p, (_, b) in CASES.items()})
    found = line_diff.hunks(old, new).cache()
    back = {r.path: r.text for r in line_diff.applied(old, found).collect()}
    for path, (a, b) in CASES.items():
        assert back.get(path) == b, path
    changed = {r.path for r in found.select("path").distinct().collect()}
    assert changed == {p for p, (a, b) in CASES.items() if a != b}
    far = sorted((r.old_start, r.old_lines, r.new_start, r.new_lines) for r in found.where("path = 'far'").collect())
    assert far == [(17, 11, 17, 11), (87, 7, 87, 7)]
    text = {r.path: r.diff for r in line_diff.unified(found).collect()}
    assert text["swap"].startswith("--- a/swap\n+++ b/swap\n@@ -1,3 +1,3 @@\n") and text["newline"] == "--- a/newline\n+++ b/newline\n@@ -1 +1,2 @@\n a\n+\n"
    assert sum(line.startswith("-x") for line in text["repeats"].split("\n")) == 10 and "+x" not in text["repeats"]


def test_a_hunk_that_does_not_fit_gives_no_text(spark):
    found = line_diff.hunks(files(spark, {"a": "x\ny"}), files(spark, {"a": "x\nz"}))
    assert line_diff.applied(files(spark, {"a": "x\nother", "b": "as it was"}), found).orderBy("path").collect()[0].text is None
    assert line_diff.applied(files(spark, {"a": "x\ny", "b": "as it was"}), found).where("path = 'b'").first().text == "as it was"


def test_diffs_are_capped_over_a_selection(spark):
    diffs = spark.createDataFrame([("s", "b", "22222"), ("s", "a", "111"), ("s", "c", "3333"), ("t", "a", "9")], "selection string, path string, diff string")
    assert {r.selection: r.diff for r in line_diff.capped(diffs, 6).collect()} == {"s": "111222", "t": "9"}


def test_no_files(spark):
    none = files(spark, {"a": None})
    assert line_diff.hunks(none, none).count() == 0 and line_diff.applied(none, line_diff.hunks(none, none)).count() == 0


def test_the_longest_rising_run():
    import pandas as pd

    dice = random.Random(1)
    for _ in range(30):
        n = dice.randrange(1, 12)
        j = dice.sample(range(50), n)
        got = line_diff.longest_rising(pd.DataFrame({"path": "p", "i": range(n), "j": j}))
        best = max(bin(m).count("1") for m in range(1 << n) if (s := [j[k] for k in range(n) if m >> k & 1]) == sorted(s))
        assert len(got) == best and list(got["j"]) == sorted(got["j"])


def test_rounds_hold_no_texts_and_leave_no_old_tables(spark, monkeypatch):
    written, real = [], line_diff.cut
    monkeypatch.setattr(line_diff, "cut", lambda df: written.append(real(df)) or written[-1])
    long = "a line that is far longer than a digest, " * 50
    old = spark.createDataFrame([("f", "\n".join([long + str(k % 7) for k in range(40)])), ("g", "a\n\nb")], "path string, text string")
    new = spark.createDataFrame([("f", "\n".join([long + str(k % 5) for k in range(40)])), ("g", "b\na\n")], "path string, text string")
    found = line_diff.hunks(old, new)
    assert {r.path: r.text for r in line_diff.applied(old, found).collect()} == {r.path: r.text for r in new.collect()}
    there = [table for table in written if all(os.path.exists(unquote(urlparse(file).path)) for file in table.inputFiles())]
    assert 2 <= len(there) < len(written)
    sizes = [table.agg(F.max(F.octet_length("line"))).first()[0] or 0 for table in there if "line" in table.columns]
    assert max(sizes) <= 32
