"""Split scans of CSV and XML: same records and order as a read by one task, whatever the ranges."""

import csv
import io
import random
import xml.etree.ElementTree as ET

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelflow.sources import ranges as rg
from labelflow.sources import readers as rd


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few bytes, so that borders fall into quotes, tags and characters."""
    settings = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key in settings:
        spark.conf.unset(key)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab",\n\r é', max_size=8), min_size=2, max_size=3), min_size=1, max_size=6), st.booleans())
def test_csv_advance_finds_record_ends(rows, quote_all):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL if quote_all else csv.QUOTE_MINIMAL).writerows(rows)
    found, held, state = [], [], 0
    for line in out.getvalue()[:-1].split("\n"):
        state = rg.csv_advance(line, state)
        held.append(line)
        if state == 0:
            found.append(next(csv.reader(io.StringIO("\n".join(held), newline="")), []))
            held = []
    assert not held and found == rows


def test_xml_advance():
    assert rg.xml_advance("<a>x", 0) == 0
    assert rg.xml_advance("<!-- <a>", 0) == 1 and rg.xml_advance("--> <a>", 1) == 0
    assert rg.xml_advance("<![CDATA[ <!-- ", 0) == 2 and rg.xml_advance(" ]]> <!-- -->", 2) == 0
    assert rg.xml_advance("<!-- ]]> --> <![CDATA[", 0) == 2 and rg.xml_advance("--> <!--", 2) == 2


def random_rows(n, seed):
    rng = random.Random(seed)
    field = lambda: "".join(rng.choice(["a", '"', ",", "\n", "\r\n", "é", "b c", ""]) for _ in range(rng.randint(0, 10)))
    return [(str(i), field() + "x", "" if rng.random() < 0.2 else field() + "y") for i in range(n)]


def write_csv_file(path, rows, **options):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, **({"lineterminator": "\n"} | options))
        w.writerow(["id", "text", "label"])
        w.writerows(rows)


@pytest.mark.parametrize("options", [{}, {"quoting": csv.QUOTE_ALL, "lineterminator": "\r\n"}])
def test_csv_in_many_ranges(small_ranges, tmp_path, options):
    rows = random_rows(150, 3)
    write_csv_file(tmp_path / "f1.csv", rows[:90], **options)
    write_csv_file(tmp_path / "f2.csv", rows[90:], **options)
    df = rd.read_csv(small_ranges, str(tmp_path), ["id", "text", "label"], null_tokens=False, order_col="o")
    got = df.orderBy("o").drop("o").collect()
    assert [(r["id"], r["text"], r["label"] or "") for r in got] == rows
    assert df.select("o.file", "o.block").distinct().count() > 20
    if options:
        return  # the one-task read turns CR LF inside quotes into LF where lines end so
    one_task = small_ranges.read.options(header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False,
                                         ignoreTrailingWhiteSpace=False).schema("id string, text string, label string").csv(str(tmp_path))
    assert sorted(map(str, one_task.collect())) == sorted(map(str, got))


def test_csv_record_over_many_ranges_and_odd_files(small_ranges, tmp_path):
    long = "line\n" * 300 + 'the "end"'
    write_csv_file(tmp_path / "long.csv", [("1", long, "a"), ("2", "short", "b"), ("3", long, "c")])
    got = rd.read_csv(small_ranges, str(tmp_path / "long.csv"), ["id", "text", "label"], order_col="o").orderBy("o").collect()
    assert [(r["id"], r["text"], r["label"]) for r in got] == [("1", long, "a"), ("2", "short", "b"), ("3", long, "c")]
    (tmp_path / "odd.csv").write_text('id,text,label\n\n1,a "b" c,x\r\n\n2,,\n3,"never closed\nat all,z\n')
    got = rd.read_csv(small_ranges, str(tmp_path / "odd.csv"), ["id", "text", "label"], order_col="o").orderBy("o").collect()
    assert [(r["id"], r["text"]) for r in got[:2]] == [("1", 'a "b" c'), ("2", None)] and got[2]["id"] == "3" and len(got) == 3
    (tmp_path / "head.csv").write_text("id,text,label\n")
    assert rd.read_csv(small_ranges, str(tmp_path / "head.csv"), ["id", "text", "label"]).count() == 0
    typed = rd.read_csv(small_ranges, str(tmp_path / "long.csv"), rd.T.StructType.fromDDL("id int, text string, label string"))
    assert typed.agg(F.sum("id")).first()[0] == 6


def reviews(n):
    rng = random.Random(5)
    body = ['<?xml version="1.0"?>\n<!DOCTYPE x>\n<sentences>']
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            body.append(f'<!-- <sentence id="no{i}"><text>out</text></sentence> -->')
        if kind == 1:
            body.append(f'<sentence id="{i}"/>')
        elif kind == 2:
            body.append(f'<sentence id="{i}"><text><![CDATA[a </sentence> <!-- kept --> {i}]]></text></sentence>')
        else:
            body.append(f'<sentence\n id="{i}" note="a > b / c"><text>é &amp; {"long " * rng.randrange(60)}{i}</text><!-- in -->'
                        f'<aspectCategories><aspectCategory category="food" polarity="positive"/></aspectCategories></sentence>')
        body.append(rng.choice(["", "\n", "  "]))
    return "".join(body) + "</sentences>"


def test_xml_in_many_ranges(small_ranges, tmp_path):
    text = reviews(80)
    (tmp_path / "r.xml").write_text(text, encoding="utf-8")
    out = rd.read_review_xml(small_ranges, {"train": str(tmp_path / "r.xml")})
    got = [(r["sentence_id"], r["text"]) for r in out.sentences.orderBy("row_order").collect()]
    want = [(s.get("id"), " ".join((s.findtext("text") or "").split(" ")).strip()) for s in ET.fromstring(text.encode())]
    assert got == want and len(got) == 80
    assert out.sentences.select("row_order.block").distinct().count() > 10
    assert out.aspects.count() == sum(len(s.findall(".//aspectCategory")) for s in ET.fromstring(text.encode()))


def test_ranges_that_change_between_passes(small_ranges, tmp_path):
    write_csv_file(tmp_path / "f.csv", random_rows(60, 4))
    records = rg.csv_records(small_ranges, str(tmp_path / "f.csv"))
    small_ranges.conf.set("spark.sql.files.maxPartitionBytes", "301")
    with pytest.raises(Exception, match="changed between passes"):
        records.collect()
