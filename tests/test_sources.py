import pytest

from tests import dump
from tomeforge.operators import counts, links, search
from tomeforge.sources import dumps, indices, multistream, tables
from tomeforge.sources.settings import Settings


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    return dump.write(tmp_path_factory.mktemp("dump"))


def test_pages_of_all_streams(spark, files):
    pages = dumps.pages_of(dumps.read_dump(spark, files[0]))
    rows = {r["page_id"]: r for r in pages.collect()}
    assert set(rows) == {1, 2, 10, 11, 20, 21, 22}
    assert rows[1]["title"] == "A & B" and rows[1]["text"].startswith("   leading") and "<b>" in rows[1]["text"]
    assert rows[2]["redirect_to"] == "Tea & more" and rows[20]["is_redirect"] and rows[20]["redirect_to"] is None
    assert {r[0] for r in dumps.pages_of(dumps.read_dump(spark, files[0]), compat_ids=True).select("page_id").collect()} == {77, 1100}


def test_scans_and_extraction(spark, files):
    pages = dumps.pages_of(dumps.read_dump(spark, files[0]))
    assert {r["page_id"] for r in dumps.raw_pages(pages).collect()} == {1, 10, 11}
    assert {r["page_id"] for r in dumps.raw_pages(pages, filter_titles=True).collect()} == {1, 11}
    assert [tuple(r) for r in links.redirects(pages).collect()] == [("Old Tea", "Tea & more")]
    assert [r["title"] for r in links.templates(pages).collect()] == ["Template:Box"]
    flat = {(r["surface"], r["entity"]): r["n"] for r in counts.anchor_counts_flat(pages).collect()}
    assert flat == {("the tea", "Tea"): 2, ("tea", "tea"): 1, ("g", "Green"): 1, ("the tea", "Green Tea"): 1, ("a & b", "A & B"): 1}
    body = {(r["surface"], r["entity"]): r["n"] for r in counts.anchor_counts_page(pages).collect()}
    assert body == {("the tea", "Tea"): 1, ("tea", "tea"): 1, ("the tea", "Green Tea"): 1, ("a & b", "A & B"): 1, ("user talk:x", "User talk:x"): 1, (":file:y", ":File:y"): 1}
    assert search.phrase_df(search.build_index(pages), "OF the").first()[0] == 1


def test_chosen_streams(spark, files):
    path, index, offsets = files
    wanted = spark.createDataFrame([(offsets[1],), (None,), (offsets[1],)], "offset long")
    rows = multistream.read_pages_at(path, wanted).collect()
    assert [(r["offset"], r["page_id"]) for r in rows] == [(offsets[1], 10), (offsets[1], 11)]
    full = {r["page_id"]: tuple(r) for r in dumps.pages_of(dumps.read_dump(spark, path)).collect()}
    every = spark.createDataFrame([(o,) for o in offsets], "offset long")
    assert {r["page_id"]: tuple(r)[1:] for r in multistream.read_pages_at(path, every).collect()} == full
    lines = multistream.lines_of(multistream.read_streams_at(path, wanted)).collect()
    assert [r["line"] for r in sorted(lines, key=lambda r: r["line_no"])] == dump.STREAMS[1].splitlines()
    by_offset = indices.pages_by_offset(indices.read_index(spark, index))
    assert multistream.one_stream(spark, path, by_offset, 2).first()["content"] == dump.STREAMS[2]
    assert multistream.one_stream(spark, path, by_offset, 3).count() == 0


def test_a_broken_stream_ends_early():
    good = dump.page("T", 1, "x").encode()
    assert [p[0] for p in multistream.pages_in(good + b"<page><title>bad</page>" + good)] == [1]
    assert list(multistream.pages_in(b"nothing")) == []


def test_indices(spark):
    lines = spark.createDataFrame([("5:2:Template:B",), ("5:1:A:b",), ("9:3:C",), ("x:4:D",), ("7",), (None,)], "value string")
    parsed = indices.parse_index_lines(lines)
    assert parsed.where("is_valid").count() == 3 and {r["title"] for r in parsed.where("is_valid").collect()} == {"Template:B", "A:b", "C"}
    grouped = {r["offset"]: r["page_ids"] for r in indices.pages_by_offset(parsed).collect()}
    assert grouped == {5: [1, 2], 9: [3]}
    assert {r["offset"]: r["page_ids"] for r in indices.templates_by_offset(lines).collect()} == {5: [2]}
    compact = indices.compact_lines(indices.pages_by_offset(parsed))
    assert sorted(r[0] for r in compact.collect()) == ["5 1,2", "9 3"]
    again = spark.createDataFrame([("5 8",), ("5 1,x,2",), ("bad",)], "value string").coalesce(1)
    assert {r["offset"]: r["page_ids"] for r in indices.parse_compact_lines(again).collect()} == {5: [1, 2]}
    assert sorted(tuple(r) for r in indices.titles_of(lines).collect()) == [("1", "A:b"), ("2", "Template:B"), ("3", "C"), ("4", "D")]
    assert indices.nth_offset(parsed.where("is_valid"), 1) == 9 and indices.nth_offset(parsed.where("is_valid"), 2) is None
    empty = lines.where("false")
    assert indices.pages_by_offset(indices.parse_index_lines(empty)).count() == 0


def test_anchor_lines(spark):
    lines = spark.createDataFrame([("1\tT\tthe tea\tTea",), ("x\ty",), ("one",), (None,)], "value string")
    assert sorted(tuple(r) for r in tables.parse_anchor_lines(lines).collect()) == [("the tea", "Tea"), ("x", "y")]


def test_a_computed_line_is_worked_out_once(spark):
    whole = spark.createDataFrame([("a", "b"), ("", "c"), ("d", "")], "x string, y string").selectExpr("concat_ws('\t', upper(x), y) as value")
    found = tables.parse_anchor_lines(whole)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("concat_ws") == 1
    assert sorted(map(tuple, found.collect())) == [("", "c"), ("A", "b"), ("D", "")]


def test_chunks_end_at_newlines():
    raw = b"aaa\nbb\ncccccccc\nd\n" * 3
    at = lambda i: (p if (p := raw.find(b"\n", i)) >= 0 else None)
    ranges = multistream.newline_chunks(len(raw), 5, at)
    assert b"".join(raw[a:b] for a, b in ranges) == raw and all(raw[b - 1 : b] == b"\n" for _, b in ranges) and len(ranges) > 3
    assert multistream.newline_chunks(10, 5, at) == [(0, 10)] and multistream.newline_chunks(0, 5, at) == []


def test_settings(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[data]\ndump = "d"\nindex = "i"\n[indices]\nindices = "x"\n[search_index]\nindex_dir = "s"\n')
    found = Settings.load(str(path))
    assert (found.dump, found.page_indices, found.search_index, found.templates) == ("d", "x", "s", "templates.xml")
    path.write_text("[data]\ndump = ''\n")
    with pytest.raises(ValueError):
        Settings.load(str(path))


def test_history_dumps_give_a_row_for_each_revision(spark, tmp_path):
    revision = lambda n: f"<revision><id>{n}</id><text>text {n}</text></revision>"
    (tmp_path / "h.xml").write_text(f"<mediawiki><page><title>A</title><id>1</id>{revision(5)}{revision(6)}</page><page><title>B</title><id>2</id></page></mediawiki>")
    pages = dumps.pages_of(dumps.read_history(spark, str(tmp_path / "h.xml")))
    assert sorted((r["title"], r["page_id"], str(r["text"])) for r in pages.collect()) == [("A", 1, "text 5"), ("A", 1, "text 6"), ("B", 2, "None")]


def test_compatible_ids_at_offsets(spark, tmp_path):
    path, _, offsets = dump.write(tmp_path)
    wanted = spark.createDataFrame([(o,) for o in offsets], "offset long")
    found = multistream.read_pages_at(path, wanted, compat_ids=True)
    every = dumps.pages_of(dumps.read_dump(spark, path), compat_ids=True)
    assert sorted((r["title"], r["page_id"]) for r in found.collect()) == sorted((r["title"], r["page_id"]) for r in every.collect())


def test_written_dumps_are_read_again(spark, tmp_path):
    from tomeforge.operators import sinks

    rows = [(1, "A & <B>", False, None, "  x\n\n[[y]] & <z> \"q\"  "), (2, "R", True, "A & \"B\"", "#R"), (3, None, False, None, None), (4, "Empty", False, None, "")]
    pages = spark.createDataFrame(rows, "page_id bigint, title string, is_redirect boolean, redirect_to string, text string")
    wanted = sorted((*r[:4], r[4] or None) for r in rows)
    sinks.write_dump(pages, str(tmp_path / "d"))
    assert sorted(map(tuple, dumps.pages_of(dumps.read_dump(spark, str(tmp_path / "d"))).collect()), key=lambda r: r[0]) == wanted
    index = multistream.write_streams(sinks.dump_xml(pages), str(tmp_path / "one.bz2"), size=3).cache()
    offsets = indices.parse_index_lines(index)
    assert offsets.select("offset").distinct().count() == 2
    found = multistream.read_pages_at(str(tmp_path / "one.bz2"), offsets).drop("offset")
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == wanted


def test_a_dump_is_written_and_read_by_many_tasks(spark, tmp_path):
    from tomeforge.operators import sinks

    ids = [*range(1000, 1430), None, None, *[1100] * 30]  # some parts end within a stream
    rows = [(i, f"T {n}", False, None, f"text {n}\n") for n, i in enumerate(ids)]
    pages = spark.createDataFrame(rows, "page_id bigint, title string, is_redirect boolean, redirect_to string, text string").repartition(5)
    path = str(tmp_path / "many.bz2")
    lines = multistream.write_streams(sinks.dump_xml(pages), path, size=20, part_pages=33)
    index = indices.parse_index_lines(lines).cache()
    sizes = [r["n"] for r in index.groupBy("offset").count().withColumnRenamed("count", "n").orderBy("offset").collect()]
    assert sizes == [20] * 23 + [2] and [p.name for p in tmp_path.iterdir()] == ["many.bz2"]
    order = [r["page_id"] for r in index.select("offset", "page_id").orderBy("offset").collect()]
    blocks = [sorted((x or 0) for x in order[k : k + 20]) for k in range(0, len(order), 20)]
    assert sum(blocks, []) == sorted(x or 0 for x in ids)
    read = multistream.read_pages_at(path, index)
    assert sorted(r["title"] for r in read.collect()) == sorted(r[1] for r in rows) and read.rdd.getNumPartitions() > 1
    assert sorted((r["offset"], r["title"]) for r in read.collect()) == sorted((r["offset"], r["title"]) for r in index.collect())
    import bz2

    assert bz2.decompress(open(path, "rb").read()).decode().count("<page>") == len(rows)
    none = multistream.write_streams(sinks.dump_xml(pages.where("false")), str(tmp_path / "none.bz2"))
    assert none.count() == 0 and (tmp_path / "none.bz2").stat().st_size == 0


def test_the_shared_folder_is_the_cluster_s(spark):
    from types import SimpleNamespace

    import pytest

    from tomeforge.sources.shared import new_path, shared_folder

    assert new_path(spark, "x").startswith(shared_folder(spark)) and new_path(spark, "x") != new_path(spark, "x")
    lacking = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        shared_folder(lacking)
