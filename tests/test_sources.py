import json

import pytest
from pyspark.sql import functions as F

from noctiluca.rag import benchmark, chunks, retrieval
from noctiluca.sources import paper_api
from noctiluca.sources.csv import read_papers, write_papers
from noctiluca.sources.feed import feed_papers, read_feed
from noctiluca.sources.resolve import resolve, split_argument
from noctiluca.sources.sinks import make_folders, save_json, save_metrics
from noctiluca.sources.synthetic import sample_papers
from noctiluca.streaming.dedup import keyed_stream, run_available

ENTRY = """<entry><id>http://p.example/{i}</id><title> Star  {i} </title><summary>Dust\n and gas</summary><published>{year}-01-02T00:00:00Z</published><updated/>
<author><name>Ann  B.</name></author><author><name> </name></author><author><name>C. D</name></author><category term="hep-th"/><category term="astro-ph.GA"/>{primary}</entry>"""
FEED = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">{}</feed>'


def page(ids, year=2021, primary=""):
    return FEED.format("".join(ENTRY.format(i=i, year=year, primary=primary) for i in ids))


def stub(options):
    """Three records in 2021, two in 2022 of which one is also in 2021; the window of 2020 fails."""

    def get(query, start, count, timeout):
        if "20200101" in query:
            raise paper_api.HttpStatus(503)
        have, year = ([3, 4], 2022) if "20220101" in query else ([1, 2, 3], 2021)
        return page(have[start : start + count], year)

    return get


class Calls:
    def __init__(self, *answers):
        self.answers, self.slept, self.asked = list(answers), [], []

    def __call__(self, query, start, count, timeout):
        self.asked.append((start, count))
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def test_queries():
    assert paper_api.category_query(["a", " b "]) == "cat:a OR cat:b"
    assert paper_api.category_query([""]).count("cat:astro-ph.") == 6
    assert paper_api.year_query(2021, 2019) == "submittedDate:[20190101000000 TO 20211231235959]"
    assert paper_api.year_query(None, 2020) == "submittedDate:[20200101000000 TO 20201231235959]"
    assert paper_api.year_query() == ""
    assert paper_api.combine("a", "", "b") == "(a) AND (b)" and paper_api.combine(" a ") == "a" and paper_api.combine() == ""
    assert paper_api.windows(2020, 2022) == [2022, 2021, 2020] and paper_api.windows(2020, None) == [2020] and paper_api.windows(None, None) == [None]


def test_retries():
    c = Calls(paper_api.HttpStatus(429), TimeoutError(), page([1]))
    assert len(paper_api.fetch_page(c, "q", 0, 5, sleep=c.slept.append)) == 1 and c.slept == [4.0, 8.0]
    c = Calls(*[TimeoutError()] * 4)
    with pytest.raises(paper_api.FetchError):
        paper_api.fetch_page(c, "q", 0, 5, sleep=c.slept.append)
    assert c.slept == [4.0, 8.0, 12.0]
    c = Calls(paper_api.HttpStatus(503))
    with pytest.raises(paper_api.FetchError):
        paper_api.fetch_page(c, "q", 0, 5, sleep=c.slept.append)
    assert c.slept == []


def test_pages():
    c = Calls(page([1, 2]), page([3]))
    rows = list(paper_api.read_window(c, "q", 2021, 10, 2, sleep=c.slept.append))
    assert [r[:3] for r in rows] == [(2021, 0, 0), (2021, 0, 1), (2021, 2, 0)] and c.slept == [3.0]
    c = Calls(page([1, 2]), FEED.format(""))
    assert len(list(paper_api.read_window(c, "q", None, 10, 2, sleep=c.slept.append))) == 2
    c = Calls(page([1, 2]), page([3]))
    assert len(list(paper_api.read_window(c, "q", None, 3, 2, sleep=c.slept.append))) == 3 and c.asked[1] == (2, 1)
    c = Calls(page([1, 2]), paper_api.HttpStatus(500))
    assert [r[-1] is None for r in paper_api.read_window(c, "q", None, 9, 2, sleep=c.slept.append)] == [True, True, False]


def test_api_source(spark, tmp_path):
    options = {"transport": "tests.test_sources:stub", "from_year": 2020, "to_year": 2022, "page": 2, "pause": 0}
    papers, errors = paper_api.fetch(spark, **options)
    rows = papers.orderBy("paper_id").collect()
    assert [(r["paper_id"], r["title"]) for r in rows] == [(1, "Star 3"), (2, "Star 4"), (3, "Star 1"), (4, "Star 2")]
    assert rows[0]["authors"] == "Ann B., C. D" and rows[0]["category"] == "astro-ph.GA" and rows[0]["year"] == "2022"
    assert [r["window"] for r in errors.collect()] == [2020]
    with pytest.raises(paper_api.FetchError):
        paper_api.fetch(spark, **options | {"to_year": 2020})
    cache = str(tmp_path / "cache")
    write_papers(papers.drop("year"), cache)
    assert paper_api.fetch(spark, cache=cache, limit=2, **options | {"to_year": 2020})[0].count() == 2


def test_api_stream(spark, tmp_path):
    spark.dataSource.register(paper_api.PaperApi)
    stream = spark.readStream.format("paper_api").options(transport="tests.test_sources:stub", from_year="2021", to_year="2022", page="2").load()
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
    import time

    for _ in range(60):
        time.sleep(1)
        query.processAllAvailable()
        if spark.read.parquet(str(tmp_path / "o")).count() >= 5:
            break
    query.stop()
    assert sorted(r["title"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["Star 1", "Star 2", "Star 3", "Star 3", "Star 4"]


def test_feed_reader(spark, tmp_path):
    (tmp_path / "f.xml").write_text(page([1], primary='<arxiv:primary_category term="astro-ph.SR"/>'))
    (tmp_path / "g.xml").write_text(page([2]))
    rows = {r["url"][-1]: r for r in feed_papers(read_feed(spark, str(tmp_path))).collect()}
    assert rows["1"]["category"] == "astro-ph.SR" and rows["2"]["category"] == "astro-ph.GA"
    assert rows["1"]["title"] == "Star 1" and rows["1"]["abstract"] == "Dust and gas" and rows["1"]["authors"] == "Ann B., C. D" and rows["1"]["year"] == "2021"


def test_csv(spark, tmp_path):
    rows = [(1, 'a "quoted", title', "two\nlines", "c", "x"), (2, "t", "", "NA", None)]
    df = spark.createDataFrame(rows, "paper_id bigint, title string, abstract string, category string, more string")
    write_papers(df, str(tmp_path / "p"))
    got = {r["paper_id"]: r for r in read_papers(spark, str(tmp_path / "p")).collect()}
    assert got[1]["title"] == 'a "quoted", title' and got[1]["abstract"] == "two\nlines" and got[2]["category"] == "NA" and got[1]["more"] == "x"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_papers(spark, str(tmp_path / "absent"))


def test_sample(spark):
    rows = sample_papers(spark).orderBy("paper_id").collect()
    assert len(rows) == 1002 and rows[0]["title"] == "Transformer Retrieval for Language Understanding Study 1" and rows[0]["year"] == 2020
    assert rows[1]["title"] == "Long-Context Language Models: Document Retrieval and Image Segmentation"
    assert rows[1]["abstract"].startswith("We study document retrieval for language understanding with") and "summarization, embedding model, and dataset on EMNLP style" in rows[1]["abstract"]
    assert rows[167]["category"] == "cs.CV" and rows[167]["year"] == 2021 and rows[1001]["paper_id"] == 1002
    first = sample_papers(spark, 2, perfect=True).orderBy("paper_id").first()
    assert first["title"] == "Transformer Retrieval for Tokenization Study 1" and first["abstract"].startswith("We present a cs.CL benchmark focused on tokenization and question answering.")


def test_resolve(spark):
    assert resolve(spark, "synthetic", per_category=1).count() == 6
    for bad in (("csv", None), ("feed", None), ("other", "x")):
        with pytest.raises(ValueError):
            resolve(spark, *bad)
    assert split_argument(" a,, b") == ["a", "b"]


def test_sinks(spark, tmp_path):
    assert all(p.is_dir() for p in make_folders(str(tmp_path)))
    assert json.loads(save_json({"a": 1}, str(tmp_path / "x/y.json")).read_text()) == {"a": 1}
    assert json.loads(save_metrics(spark.range(2), str(tmp_path / "m.json")).read_text()) == [{"id": 0}, {"id": 1}]
    with pytest.raises(ValueError):
        save_metrics(spark.range(5), str(tmp_path / "m.json"), most=3)


def test_stream_dedup_over_batches(spark, tmp_path):
    schema = "url string, title string, published string, category string"
    rows = [("u", "a", "d", "astro-ph.GA"), ("", "b", "d", "astro-ph.GA"), ("u", "c", "d", "astro-ph.GA"), ("", "b", "d", "astro-ph.GA"), ("v", "e", "d", "hep-th")]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for i in range(0, 5, 2):
        spark.createDataFrame(rows[i : i + 2], schema).coalesce(1).write.mode("append").parquet(source)
        run_available(keyed_stream(spark.readStream.schema(schema).parquet(source)), out, state)
    assert sorted(r["dedup_key"] for r in spark.read.parquet(out).collect()) == ["b::d", "u"]


def test_questions(spark, tmp_path):
    good = {"id": "q1", "question": "?", "topic": "t", "question_type": "method", "difficulty": "easy", "gold_papers": [], "gold_chunks": [], "reference_answer": "a"}
    (tmp_path / "q.json").write_text(json.dumps([good, good | {"id": "q2", "question_type": "opinion", "reference_answer": "\xa0"}, {k: v for k, v in good.items() if k != "difficulty"} | {"id": "q3"}]))
    got = {tuple(r) for r in benchmark.violations(benchmark.read_questions(spark, str(tmp_path / "q.json"))).collect()}
    assert got == {("q2", "question_type", "not allowed"), ("q2", "reference_answer", "missing"), ("q3", "difficulty", "missing")}


def test_chunks(spark):
    df = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(25))), (8, None), (9, " "), (10, "one two")], "doc_id bigint, text string")
    rows = chunks.fixed_chunks(df, "doc_id", "text", 10, 3).orderBy("paper_id", "chunk_index").collect()
    assert [(r["chunk_id"], r["word_count"]) for r in rows] == [("10_chunk_000", 2), ("7_chunk_000", 10), ("7_chunk_001", 10), ("7_chunk_002", 10), ("7_chunk_003", 4)]
    assert rows[2]["chunk_text"].startswith("w7 ") and rows[4]["chunk_text"].endswith("w24")
    with pytest.raises(ValueError):
        chunks.fixed_chunks(df, "doc_id", "text", 5, 5)
    parts = chunks.section_chunks(spark.createDataFrame([(1, "intro text\n# Data\na b c\nd e\n2.1 Results Here\nf g")], "doc_id bigint, text string"), "doc_id", "text", 4, 1).orderBy("chunk_index").collect()
    assert [(r["section_title"], r["chunk_text"]) for r in parts] == [(None, "intro text"), ("Data", "a b c d"), ("Data", "d e"), ("Results Here", "f g")]
    flags = chunks.chunk_flags(spark.createDataFrame([("see [3] and x = 2",), (None,)], "chunk_text string")).collect()
    assert flags[0]["contains_citation_marker"] and flags[0]["contains_equation_like_text"] and flags[0]["word_count"] == 6 and flags[1]["word_count"] == 0


def test_bm25_by_hand(spark):
    import math

    items = spark.createDataFrame([("a", "dust dust star"), ("b", "star gas"), ("c", "gas"), ("c", "gas"), ("d", None), (None, "dust")], "item_id string, text string")
    got = {r["item_id"]: r["score"] for r in retrieval.bm25(spark.createDataFrame([("q", "Dust, dust")], "query_id string, text string"), items, 5).collect()}
    n, avg = 4, (3 + 2 + 1 + 0) / 4
    idf = math.log(1 + (n - 1 + 0.5) / 1.5)
    assert got == {"a": round(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg)), 6)}
    both = retrieval.rerank(spark.createDataFrame([("q", "a", 2.0, 1), ("q", "b", 1.0, 2)], "query_id string, item_id string, score double, rank int"), spark.createDataFrame([("q", "b", 1.0)], "query_id string, item_id string, score double"), 1)
    assert both.first()["item_id"] == "b"
    assert retrieval.with_evidence(both, 0.9).count() == 0


def test_balanced_topics(spark):
    df = spark.createDataFrame([("t", i) for i in range(5)] + [("u", 1), (None, 9), ("t", 0)], "topic_cluster string, paper_id bigint")
    assert {(r["topic"], r["paper_id"]) for r in chunks.topic_balanced(df, 2).select("topic", F.col("paper_id")).collect()} == {("t", 0), ("t", 1), ("u", 1)}


def test_offsets_after_a_restart():
    """A new reader goes on from the checkpoint's offset: nothing comes again, and a window that fails keeps its place."""
    options = {"transport": "tests.test_sources:stub", "from_year": "2020", "to_year": "2022", "page": "2", "longest_wait": "0"}
    first = paper_api.PaperApiStream(options)
    end = first.latestOffset()
    assert end == {"2022": 2, "2021": 4, "2020": 0}
    assert [(p.year, p.start, p.count) for p in first.partitions(first.initialOffset(), end)] == [(2022, 0, 2), (2021, 0, 2), (2021, 2, 2)]
    again = paper_api.PaperApiStream(options)
    assert again.latestOffset() == end and again.partitions(end, again.latestOffset()) == []
    assert sum(1 for p in again.partitions({"2022": 2, "2021": 2}, end) for _ in again.read(p)) == 1


def test_stream_restart(spark, tmp_path):
    spark.dataSource.register(paper_api.PaperApi)

    def run():
        stream = spark.readStream.format("paper_api").options(transport="tests.test_sources:stub", from_year="2021", to_year="2022", page="2").load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
        query.processAllAvailable()
        query.stop()
        return spark.read.parquet(str(tmp_path / "o")).where("error is null").count()

    assert run() == 5
    assert run() == 5
