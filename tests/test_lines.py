import csv

from hypothesis import given, settings
from hypothesis import strategies as st

from wenloom.sources import lines

SCHEMA = "line_id long, raw_line string, text string"


def judged(spark, raws):
    df = spark.createDataFrame([(i, r, "other") for i, r in enumerate(raws)], SCHEMA)
    bad = {r["line_id"]: (r["reason"], r["broken_field"]) for r in lines.failures(df).collect()}
    good = {r["line_id"]: (r["text"], r["label_id"]) for r in lines.loaded(df).collect()}
    assert not bad.keys() & good.keys() and len(bad) + len(good) == len(raws)
    return [bad.get(i) or good[i] for i in range(len(raws))]


def plain_reason(raw):
    """Character by character, without patterns."""
    s = (raw or "").strip()
    fields, i = [], 0
    while True:
        if s[i : i + 1] == '"':
            j, out = i + 1, ""
            while True:
                if j >= len(s):
                    return "quoting"
                if s[j] == '"':
                    if s[j + 1 : j + 2] == '"':
                        out += '"'
                        j += 2
                        continue
                    break
                out += s[j]
                j += 1
            i = j + 1
            if i < len(s) and s[i] != "\t":
                return "quoting"
        else:
            j = s.find("\t", i)
            j = len(s) if j < 0 else j
            out, i = s[i:j], j
        fields.append(out)
        if i >= len(s):
            break
        i += 1
    if len(fields) != 2:
        return "columns"
    label = fields[1].strip()
    if not fields[0].strip() or not (label.isascii() and label.isdigit() and int(label) <= 9):
        return "value"
    return None


def test_cases(spark):
    assert judged(spark, ["x\t0", "x\t42", "x\tabc", "x\ty\t0", "x", "", None, "x\t", "　", "a\t 8 ", 'a\t"5"\r', '"a"x\t1', '"a\tb"\t007', '"say ""hi"""\t3', 'a "b"\t1', '" "\t1', "a\t-1", "a\t１", '"a\t1']) == [
        ("x", 0), ("value", "label_id"), ("value", "label_id"), ("columns", "label_id"), ("columns", "label_id"), ("columns", "text"), ("columns", "text"), ("columns", "label_id"), ("columns", "text"),
        ("a", 8), ("a", 5), ("quoting", "text"), ("a\tb", 7), ('say "hi"', 3), ('a "b"', 1), ("value", "text"), ("value", "label_id"), ("value", "label_id"), ("quoting", "text"),
    ]


def test_long_lines_and_empty_table(spark):
    many = '"' + '""' * 40_000 + '"\t3'
    assert judged(spark, [many, "\t".join("a" * 1 for _ in range(30_000)), "x" * 300_000 + "\t1", " " * 50_000 + "y\t2"])[0] == ('"' * 40_000, 3)
    assert judged(spark, ["\t".join(["a"] * 30_000)]) == [("columns", "label_id")]
    empty = spark.createDataFrame([], SCHEMA)
    assert lines.failures(empty).count() == lines.loaded(empty).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet='ab"\t 09　', max_size=12), min_size=40, max_size=60))
def test_against_scanner(spark, raws):
    got = judged(spark, raws)
    for raw, g in zip(raws, got):
        want = plain_reason(raw)
        assert (g[0] if g[0] in ("quoting", "columns", "value") and want else None) == want, raw


def test_round_trip(spark):
    rows = [('a "b"', 1), ("c\td", 2), ('"', 3)]
    raws = ['"' + t.replace('"', '""') + f'"\t{n}' for t, n in rows]
    assert judged(spark, raws) == rows
    assert next(csv.reader([raws[1]], delimiter="\t")) == ["c\td", "2"]
