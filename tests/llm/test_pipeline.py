"""The pipeline on rows with NULLs, repeats, and columns named like its own."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _text string, _key string, _lines string, "
          "_kept string, n_lines long, removed string, key string, root string, ids string")


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(n))


def tables(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    r = random.Random(2)
    labels = [(k, 1, int(k % 5 == 0)) for k in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(k, "How many parts does " + prose(r, 20) + " need in all?") for k in range(3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def extra(*row):
    return (*row, "t", "k", "l", "kept", 5, "r", "key", "root", "ids")


def sample():
    r = random.Random(7)
    rows = []
    for k in range(60):
        words = prose(r, 60)
        text = words + (" zorgwort hateful zorgwort hateful zorgwort" if k % 5 == 0 else "")
        rows.append((k, text, "en", "s", len(text)))
    long_text = prose(r, 300)
    rows += [(100, long_text, "en", "s", 1), (101, long_text + " more", "en", "s", 1), (102, long_text, None, None, None),
             (103, "common opening line of all\n" + prose(r, 40), "en", "s", 1), (104, "common opening line of all\n" + prose(r, 40), "en", "s", 1),
             (None, None, None, None, None), (105, None, "en", "s", 0), (106, "", "en", "s", 0)]
    return [extra(*x) for x in rows + rows[-4:-3]]


def test_every_stage_takes_effect_and_keeps_columns(spark, tmp_path):
    rows = sample()
    items = tables(spark, str(tmp_path), rows)
    hit = prose(random.Random(9), 30) + " " + items[1][1] + " " + prose(random.Random(10), 30)
    with_hit = rows + [extra(200, hit, "en", "s", 1)]
    docs = spark.createDataFrame(with_hit, SCHEMA)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            path = f"{tmp_path}/{name.replace(' ', '-')}"
            out.write.parquet(path)
            out = spark.read.parquet(path)
            assert out.filter("_text <> 't' OR _key <> 'k' OR _lines <> 'l' OR _kept <> 'kept' OR n_lines <> 5 OR removed <> 'r' "
                              "OR key <> 'key' OR root <> 'root' OR ids <> 'ids'").count() == 0
        seen[name] = docs = out
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert {1, 2, 3, 100, 103, 200} <= ids["toxicity"]
    dedup = {r.doc_id: r.text for r in seen["line dedup"].collect()}
    assert dedup[103].startswith("common opening") and not dedup[104].startswith("common opening")
    # the copies of one text lose their only line to the first of them; one of the empty texts stays
    assert 100 in ids["near-duplicates"] and len(ids["near-duplicates"] & {101, 102, 105, 106, None}) == 1
    assert 200 in ids["near-duplicates"] and 200 not in ids["decontamination"] and 1 in ids["decontamination"]
    assert seen["sentence pieces"].filter("exact").count() == seen["decontamination"].count()


def test_empty_documents(spark, tmp_path):
    tables(spark, str(tmp_path), [])
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.count() == 0 and "ids" in result.columns


def test_equal_rows_share_decisions(spark, tmp_path):
    twice = [extra(7, "one line of text that comes twice", "en", "s", 1)] * 3
    tables(spark, str(tmp_path), twice)
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 1
