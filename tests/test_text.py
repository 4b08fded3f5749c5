"""Text functions: results worked by hand, and what holds for every result."""

import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sourcequarry.functions import text
from sourcequarry.operators import excerpt


def random_texts(count, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abé \n", weights=[5, 5, 1, 1, rng.choice([0.1, 1, 4])], k=rng.randrange(0, 400)))
            for _ in range(count)]


def middle(spark, value, limit, mode):
    return spark.createDataFrame([(value,)], "t string").select(text.truncate_middle("t", limit, mode)).first()[0]


def test_truncate_middle_worked_by_hand(spark):
    value = "abcdef\nghi\njklmnop"
    for mode in ("intended", "reference"):
        assert middle(spark, value, 18, mode) == value
        assert middle(spark, value, 12, mode) == "abc ... TRUNCATED 1 LINES AND 6 CHARACTERS ... i\njklmnop"
    letters = "0123456789" * 3  # more goes than stays: only the end remains, where the original repeats text
    assert middle(spark, letters, 10, "intended") == " ... TRUNCATED 0 LINES AND 20 CHARACTERS ... " + letters[20:]
    assert middle(spark, letters, 10, "reference") == letters[:25] + " ... TRUNCATED 0 LINES AND 20 CHARACTERS ... " + letters[15:]


@pytest.mark.parametrize("limit", [100, 37])
def test_truncate_middle_keeps_two_ends(spark, limit):
    texts = random_texts(400, 1)
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for value, out in rows.select("t", text.truncate_middle("t", limit, "intended")).collect():
        if len(value) <= limit:
            assert out == value
            continue
        head, lines, characters, tail = re.fullmatch(
            r"(.*) \.\.\. TRUNCATED (\d+) LINES AND (\d+) CHARACTERS \.\.\. (.*)", out, re.DOTALL).groups()
        assert len(head) + len(tail) == limit and int(characters) == len(value) - limit
        assert value.startswith(head) and value.endswith(tail)
        assert int(lines) == value.count("\n") - head.count("\n") - tail.count("\n")


def around(spark, value, target, limit, clean):
    rows = spark.createDataFrame([(value, target)], "t string, target string")
    return excerpt.truncate_around(rows, "out", "t", "target", limit, clean).first().out


def test_truncate_around_worked_by_hand(spark):
    value = "abcdefghijklmnopqrstuvwxyz"
    assert around(spark, value, "m", 16, False) == "abcd... TRUNCATED ...ijklmnopq... TRUNCATED ...vwxyz"
    assert around(spark, value, "a", 16, False) == "abcdefgh... TRUNCATED ...stuvwxyz"
    assert around(spark, value, "m", 16, True) == "ijklmnopq"  # the outer pieces hold no whole line
    assert around(spark, value, "m", 26, True) == value


@pytest.mark.parametrize("clean", [True, False])
def test_truncate_around_keeps_the_target_and_pieces_in_order(spark, clean):
    rng = random.Random(2)
    cases = []
    for i, value in enumerate(random_texts(600, 3)):
        start = rng.randrange(0, len(value) + 1)
        target = value[start:start + rng.randrange(1, 12)]
        if target.strip():
            cases.append((i, value, target))
    rows = spark.createDataFrame(cases, "i int, t string, target string")
    for row in excerpt.truncate_around(rows, "out", "t", "target", 90, clean).collect():
        if len(row.t) <= 90:
            assert row.out == row.t
            continue
        pieces = row.out.split("... TRUNCATED ...")
        assert len(pieces) <= 3 and sum(map(len, pieces)) <= 90 + len(row.target) + 4
        if not clean:
            assert row.target.strip() in row.out
        at = 0
        for piece in pieces:
            at = row.t.find(piece.strip("\n"), at)
            assert at >= 0
            at += len(piece.strip("\n"))


def test_truncate_around_needs_its_target_in_long_texts_only(spark):
    rows = spark.createDataFrame([("short", "zz")], "t string, target string")
    assert excerpt.truncate_around(rows, "out", "t", "target", 90).first().out == "short"
    rows = spark.createDataFrame([("long " * 50, "zz")], "t string, target string")
    with pytest.raises(Exception, match="target not found"):
        excerpt.truncate_around(rows, "out", "t", "target", 90).collect()


def test_truncate_around_of_an_empty_text(spark):
    rows = spark.createDataFrame([("", ""), (None, ""), ("ab", "b")], "t string, target string")
    for clean in (True, False):
        assert [r.out for r in excerpt.truncate_around(rows, "out", "t", "target", 90, clean).collect()] == ["", None, "ab"]


def test_hashes_and_base64(spark):
    values = ["", "a", "tab\t, nul\0, line\r\n and 🧭", "x" * 1_000_000]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for row in rows.select("v", text.query_hash("v").alias("h"), text.short_hash("v").alias("s"),
                           text.encode_base64("v").alias("b"),
                           text.decode_base64(text.encode_base64("v")).alias("back")).collect():
        raw = row.v.encode()
        assert row.h == hashlib.sha256(raw).hexdigest()
        assert row.s == hashlib.md5(raw).hexdigest()[:8]
        assert row.b == base64.b64encode(raw).decode()
        assert row.back == row.v


def test_decode_base64_of_bad_values(spark):
    bad_utf8 = base64.b64encode(b"\xff\xfe").decode()
    rows = spark.createDataFrame([("YQ",), (bad_utf8,), ("",), (None,)], "v string")
    decoded = [r[0] for r in rows.select(text.decode_base64("v")).collect()]
    assert decoded[1:] == [None, "", None]
    with pytest.raises(Exception, match="Failed to decode"):
        spark.createDataFrame([(bad_utf8,)], "v string").select(text.decode_base64("v", "fail")).collect()


def test_format_list_and_dict(spark):
    rows = spark.createDataFrame(
        [(["b", "a"], {"y": "2", "x": "1"}), ([], {}), (None, None)], "a array<string>, m map<string,string>")
    got = [tuple(r) for r in rows.select(text.format_list("a"), text.format_dict("m")).collect()]
    assert got == [("a, b", "x: 1, y: 2"), ("None", "None"), ("None", "None")]
    numbers = spark.createDataFrame([([10, 9],)], "a array<int>")
    assert numbers.select(text.format_list("a")).first()[0] == "10, 9"


def test_strip_takes_any_white_space(spark):
    values = ["  a b\n\n", "\u00a0\u3000x\u2028\x1f", "\x85y\x0b", "", " \n"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in rows.select(text.strip("v")).collect()] == [v.strip() for v in values]


def test_names_and_paths(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column).first()[0]

    lit = F.lit
    assert value(text.parent_scope(lit("<module>"))) == ""
    assert value(text.parent_scope(lit("C"))) == ""
    assert value(text.parent_scope(lit("C.m.f"))) == "C.m"
    assert value(text.qualified_name(lit("<module>"), lit("f"))) == "f"
    assert value(text.qualified_name(lit("C"), lit("f"))) == "C.f"
    assert value(text.import_to_path(lit("a.b"))) == "a/b.py"
    assert value(text.import_to_path(lit(".y"))) == "/y.py"
    assert value(text.relative_path(lit("/base/x/y.py"), lit("/base/x"))) == "y.py"
    assert value(text.relative_path(lit("/base/xx/y.py"), lit("/base/x"))) == "/base/xx/y.py"
    assert value(text.file_name(lit("a/b/c.py"))) == "c.py"
    assert value(text.line_count(lit("a\nb"))) == 2
    assert value(text.line_count(lit(""))) == 1


def test_timestamps(spark):
    rows = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02 03:04:05.000600' AS a, TIMESTAMP_NTZ'2024-01-02 03:04:05' AS b")
    got = rows.select(text.format_timestamp("a"), text.format_timestamp("a", True), text.iso_timestamp("a"),
                      text.iso_timestamp("b"), (text.parse_iso_timestamp(text.iso_timestamp("a")) == F.col("a")),
                      text.interaction_name("a"), text.log_name("b", F.lit("query"), F.lit("p"))).first()
    assert tuple(got) == (
        "20240102_030405", "20240102_030405_000600", "2024-01-02T03:04:05.000600", "2024-01-02T03:04:05", True,
        "llm_interaction_20240102_030405_000600.txt",
        f"20240102_030405_query_{hashlib.md5(b'p').hexdigest()[:8]}_prompt.txt")


def test_templates_are_filled_once(spark):
    rows = spark.createDataFrame([("{b} {x}", "B")], "a string, b string")
    assert rows.select(text.fill_template("<{a}|{b}|{{}}>", {"a": F.col("a"), "b": F.col("b")})).first()[0] == "<{b} {x}|B|{}>"


def test_interaction_text(spark):
    rule = "=" * 80
    rows = spark.createDataFrame([("p", "r")], "prompt string, response string")
    assert rows.select(text.interaction_text("prompt", "response")).first()[0] == (
        f"PROMPT:\np\n\n{rule}\nRESPONSE:\n{rule}\n\nr\n")
