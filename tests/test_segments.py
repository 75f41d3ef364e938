from pyspark.sql import functions as F

from quern.functions import segments


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_pack(spark):
    text = "[Page 1]\n" + "a" * 50 + "[Page 2]\n" + "b" * 50 + "[Page 3]\n" + "c" * 300
    got = one(spark, segments.pack_pages(F.lit(text), 150))
    assert [c[:8] for c in got] == ["[Page 1]", "[Page 3]"] and "".join(got) == text
    assert one(spark, segments.pack_pages(F.lit("x" * 20), 20)) == ["x" * 20]
    assert one(spark, segments.pack_pages(F.lit("x" * 30), 20)) == ["[Page " + "x" * 30]


def test_tail(spark):
    text = "w" * 100 + "\nReferences\n[1] x"
    assert one(spark, segments.strip_tail(F.lit(text))) == "w" * 100 + "\n"
    early = "w\n References \n" + "v" * 100 + "\nReferences\n"
    assert one(spark, segments.strip_tail(F.lit(early))) == early


PAPER = "Title\nAbstract\nshort\n1. Introduction\n" + "i" * 8100 + "\n2 Materials and Methods:\nmix\nResults and Discussion\nyield\nSupplementary Material\nsupp\nReferences\n[1]"


def test_sections(spark):
    got = one(spark, segments.split_sections(F.lit(PAPER)))
    assert [(s.kind, s.heading) for s in got] == [
        ("front", "Abstract"), ("results", "Introduction"), ("methods", "Materials and Methods"), ("results", "Results and Discussion"), ("methods", "Supplementary Material"), ("back", "References"),
    ]
    assert one(spark, segments.split_sections(F.lit("Abstract\nonly one"))) == []
    assert one(spark, segments.split_sections(F.lit(PAPER), preamble=True))[0].body == "Title"


def test_chunks(spark):
    got = one(spark, segments.chunk_by_section(F.lit(PAPER), 4000))
    assert [c.label for c in got][:1] == ["methods"] and got[0].text == "mix\n\nsupp" and got[-1].label == "front"
    assert [c.label for c in one(spark, segments.chunks_for(F.lit("V1"), F.lit("abc")))] == ["chars[1]"]
    assert [c.label for c in one(spark, segments.chunks_for(F.lit("V3"), F.lit("abc")))] == ["body[1]"]
    table = "x\n[Table on page 2]\n" + "\n".join(f"row{i} | {i * 1000}" for i in range(40))
    got = one(spark, segments.chunk_by_section(F.lit(table)))
    assert [c.label for c in got] == ["body[1]", "tables"]
    assert one(spark, segments.collect_tables(F.lit("[Table on page 1]\n | | \nprose"))) == ""
