import csv
import json
import re
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from moodmill.operators.platforms import OUTCOME_SCHEMA, platform_table
from moodmill.plans.topic import analyze_text, analyze_topic, ordered_results
from moodmill.sinks import export as X

NOW = "2026-08-10T12:00:00Z"


def docs(spark):
    rows = [
        ("rss", f"rss-{i}", text, "en", "https://x", "feed", f"2026-08-10T0{i}:00:00Z")
        for i, text in enumerate(["I love Robinhood", "Robinhood is terrible", "Robinhood in \"Austin\", is\nok", "nothing here"])
    ] + [("bluesky", "b-1", "robinhood is great", "fr", "", "", None), ("bluesky", "b-1", "robinhood is great", "fr", "", "", None)]
    df = spark.createDataFrame(rows, "platform string, doc_id string, text string, language string, url string, author string, posted_at string")
    return df.withColumn("posted_at", F.col("posted_at").cast("timestamp"))


def outcomes(spark, **status):
    rows = [(p, s, 3, None if s == "ok" else f"{p} broke", 5) for p, s in status.items()]
    return spark.createDataFrame(rows, OUTCOME_SCHEMA)


def run(spark, topic="Robinhood", **kw):
    return analyze_topic(docs(spark), topic, platforms=platform_table(spark), now=NOW, **kw)


def test_topic(spark):
    a = run(spark, aspects=["robinhood"])
    assert a.results.count() == 4 and not a.partial
    by = {r["platform"]: (r["sample_size"], r["modal_label"]) for r in a.by_platform.collect()}
    assert by == {"bluesky": (1, "positive"), "rss": (3, "neutral")}
    assert a.by_aspect.first()["sample_size"] == 4
    assert [r["doc_id"] for r in ordered_results(a).collect()] == ["b-1", "rss-2", "rss-1", "rss-0"]


def test_filters_and_limit(spark):
    assert run(spark, limit=1).results.count() == 2
    assert run(spark, location="austin").results.count() == 1
    assert run(spark, language="fr").results.count() == 1
    assert run(spark, since_seconds=11 * 3600 + 60).results.count() == 3  # rss-1, rss-2 and the undated post
    assert run(spark, wanted=["RSS"]).results.count() == 3
    empty = run(spark, topic="zzz")
    assert empty.aggregate.first()["modal_label"] == "" and empty.by_platform.count() == 0


def test_partial_and_failures(spark):
    asked = ["rss", "bluesky"]
    healthy = run(spark, wanted=asked, outcomes=outcomes(spark, rss="ok", bluesky="ok"))
    assert not healthy.partial and healthy.warnings.count() == 0
    part = run(spark, wanted=asked, outcomes=outcomes(spark, rss="ok", bluesky="failed"))
    assert part.partial and part.results.count() == 3
    assert [tuple(r) for r in part.warnings.collect()] == [("bluesky", "bluesky broke")]
    with pytest.raises(RuntimeError, match="bluesky: bluesky broke; rss: rss broke"):
        run(spark, wanted=asked, outcomes=outcomes(spark, rss="failed", bluesky="failed"))
    with pytest.raises(ValueError, match="topic is required"):
        run(spark, topic="  ")


def text_docs(spark):
    rows = [(0, "a", "I love this, it is great", ["this"]), (1, "", "terrible", None)]
    return spark.createDataFrame(rows, "index int, id string, text string, aspects array<string>")


def test_text(spark):
    a = analyze_text(text_docs(spark), include_aspects=True, now=NOW)
    assert a.aggregate.first()["sample_size"] == 2 and a.aspect_scores.count() == 1
    none = analyze_text(text_docs(spark).where("false"), now=NOW)
    assert none.aggregate.first()["sample_size"] == 0


def lines(path):
    return [line for f in sorted(path.glob("part-*")) for line in f.read_text().splitlines()]


def records(path):
    (file,) = path.glob("part-*.csv")
    with open(file, newline="") as f:
        return list(csv.reader(f))


def test_csv(spark, tmp_path):
    X.export_text_csv(analyze_text(text_docs(spark), now=NOW).results, str(tmp_path / "t"))
    got = records(tmp_path / "t")
    assert got[0] == ["index", "label", "confidence", "polarity", "p_negative", "p_neutral", "p_positive"]
    assert [r[:2] for r in got[1:]] == [["0", "positive"], ["1", "negative"]]
    assert sum(map(float, got[1][4:])) == pytest.approx(1, abs=1e-5)

    X.export_topic_csv(run(spark).results, str(tmp_path / "c"))
    got = records(tmp_path / "c")
    assert ",".join(got[0]) == "platform,doc_id,created_at,label,confidence,polarity,p_negative,p_neutral,p_positive,text"
    rows = {r[1]: r for r in got[1:]}
    assert rows["b-1"][2] == "" and rows["rss-0"][2] == "2026-08-10T00:00:00Z"
    assert rows["rss-2"][9] == 'Robinhood in "Austin", is\nok'

    X.export_topic_csv(run(spark, topic="zzz").results, str(tmp_path / "e"))
    assert len(records(tmp_path / "e")) == 1


def test_ndjson(spark, tmp_path):
    a = analyze_text(text_docs(spark), include_aspects=True, now=NOW)
    X.export_text_ndjson(a.results, str(tmp_path / "t"), a.aspect_scores)
    first, second = map(json.loads, lines(tmp_path / "t"))
    assert first["id"] == "a" and first["overall"]["label"] == "positive" and first["analyzed_at"] == NOW
    assert first["aspects"][0]["aspect"] == "this" and "id" not in second and "aspects" not in second
    assert set(first["overall"]["probabilities"]) == {"negative", "neutral", "positive"}

    t = run(spark)
    X.export_topic_ndjson(t.results, t.aggregate, str(tmp_path / "n"))
    got = [json.loads(line) for line in lines(tmp_path / "n")]
    assert all("document" in o and "result" in o for o in got[:-1]) and set(got[-1]) == {"aggregate"}
    assert got[-1]["aggregate"]["sample_size"] == 4
    assert got[-1]["aggregate"]["label_counts"] == {"negative": 1, "neutral": 1, "positive": 2}


def test_json_and_xml(spark, tmp_path):
    a = run(spark, aspects=["love", "robinhood"], wanted=["rss", "bluesky"], outcomes=outcomes(spark, rss="ok", bluesky="failed"))
    X.export_analysis_json(a, str(tmp_path / "j"))
    (line,) = lines(tmp_path / "j")
    body = json.loads(line)
    assert body["topic"] == "Robinhood" and body["partial"] is True and len(body["results"]) == 3
    assert body["warnings"] == [{"platform": "bluesky", "message": "bluesky broke"}]
    assert set(body["by_platform"]) == {"rss"} and set(body["by_aspect"]) == {"love", "robinhood"}
    assert [x["aspect"] for x in body["results"][0]["result"]["aspects"]] == ["love", "robinhood"]

    X.export_analysis_xml(a, str(tmp_path / "x"))
    xml = "".join(lines(tmp_path / "x" / "results"))
    assert '<result platform="rss" id="rss-0">' in xml and "probabilities" not in xml
    assert "<sample_size>3</sample_size>" in "".join(lines(tmp_path / "x" / "aggregate"))


def test_json_of_many_results_is_cut_between_results(spark, tmp_path):
    a = run(spark, aspects=["love", "robinhood"])
    by_field = X.analysis_envelope(a).groupBy("field").count().collect()
    assert {r["field"]: r["count"] for r in by_field} == {
        "topic": 1, "results": 4, "aggregate": 1, "by_platform": 1, "by_aspect": 1, "partial": 1,
    }
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        X.export_analysis_json(a, str(tmp_path / "j"))
    finally:
        spark.conf.set(coalesce, before)
    assert len(list((tmp_path / "j").glob("part-*"))) > 1
    body = json.loads("".join(lines(tmp_path / "j")))
    assert [r["document"]["document"]["id"] for r in body["results"]] == ["b-1", "rss-0", "rss-1", "rss-2"]
    assert body["aggregate"]["sample_size"] == 4 and body["partial"] is False and "warnings" not in body


def test_json_of_nothing(spark, tmp_path):
    X.export_analysis_json(run(spark, topic="z\"zz", aspects=["love"]), str(tmp_path / "j"))
    body = json.loads("".join(lines(tmp_path / "j")))
    assert body["topic"] == "z\"zz" and body["results"] == [] and body["by_platform"] == {} == body["by_aspect"]
    assert body["aggregate"]["sample_size"] == 0


def test_xml_results_are_not_gathered_in_one_task(spark, tmp_path):
    a = run(spark, aspects=["love"])
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        X.export_analysis_xml(a, str(tmp_path / "x"))
    finally:
        spark.conf.set(coalesce, before)
    files = sorted((tmp_path / "x" / "results").glob("part-*"))
    assert len(files) > 1
    found = [re.findall(r' id="([^"]+)"', f.read_text()) for f in files]
    assert [i for ids in found for i in ids] == ["b-1", "rss-0", "rss-1", "rss-2"]
    for f in files:
        assert f.read_text().strip() == "" or ElementTree.parse(f).getroot().tag == "results"
    assert len(list((tmp_path / "x" / "by_platform").glob("part-*"))) == 1
