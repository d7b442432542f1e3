"""The pipeline's stages against the brute-force rules of their operators, on a small corpus."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import corpus_pipeline
import pyarrow as pa
from palaver.llm import common, langid, pieces, substrings
from test_minhash import brute as near_classes
from test_mixing import brute_targets
from test_substrings import brute as cut

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(9)
    words = {lang: ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(300)] for lang, parts in (("xa", ["ka", "ro", "mi"]), ("xb", ["wic", "ond", "feth"]))}
    rows = []
    passage = [rng.choice(words["xa"]) for _ in range(70)]
    for i in range(120):
        lang = "xa" if i % 3 else "xb"
        text = [rng.choice(words[lang]) for _ in range(rng.randint(20, 160))]
        if i % 8 == 1:
            text[10:10] = passage
        rows.append((i, " ".join(text), lang, f"s{i % 4}" if i % 9 else None))
    rows += [(200 + i, rows[i][1], rows[i][2], "s9") for i in range(10)]
    rows += [(300 + i, rows[20 + i][1].replace(" ", "\n", 3) + " extra", rows[20 + i][2], "s9") for i in range(10)]
    rows += [(400, None, "xa", "s1"), (401, "", "xa", "s1"), (402, "1 2 3", "xb", None), (0, rows[0][1], "xb", rows[0][3])]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in rows]


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, [tuple(r) for r in docs.collect()])
        assert name == "sentencepiece" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    before, after = seen["language_id"]
    compressors = langid._compressors(tuple(langid.sample_dictionaries(spark.createDataFrame(before, SCHEMA)).items()), langid.LEVEL)
    kept = [r for r in before if (g := langid.guess(r[1], compressors))[0] != "und" and g[2] >= 0.002]
    assert Counter(after) == Counter(kept) and len(kept) >= len(before) - 6

    before, after = seen["near_dedup"]
    classes = near_classes([r[:2] for r in before])
    assert sorted(r[0] for r in after) == sorted(set(classes.values()))

    before, after = seen["substring_dedup"]
    digest = lambda t: hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", t)).encode()).hexdigest()
    assert sorted((r[0], digest(r[1])) for r in after) == sorted((d, h) for d, _, _, h in cut([r[:2] for r in before], 50))
    assert all(r[4] == len(r[1]) for r in after) and sum(len(r[1]) for r in after) < sum(len(r[1]) for r in before)

    before, after = seen["mix_sources"]
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r[3]] += len(r[1].split())
    for r in after:
        taken[r[3]] += len(r[1].split())
    for source, target in brute_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= max(len(r[1].split()) for r in before)
    assert set(after) <= set(before) and max(Counter(after).values()) <= 2

    before, after = seen["sentencepiece"]
    model = pieces.Model(corpus_pipeline.PIECE_MODEL)
    assert Counter(r[:5] for r in after) == Counter(before)
    assert all(r[6] and pieces.decode_ids(r[5], model.spelled) == r[1] for r in after)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_ids_and_clashing_columns(spark, tmp_path):
    rows = [(None if i % 3 == 0 else r[0], *r[1:], f"own{i % 2}", i % 2, None) for i, r in enumerate(corpus())]
    names = ("_language string", "_copy int", "_n bigint")
    spark.createDataFrame(rows, f"{SCHEMA}, {', '.join(names)}").write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == [*(c.split()[0] for c in SCHEMA.split(", ")), "_language", "_copy", "_n", "pieces", "lossless"]
    after = found.collect()
    assert all(r.lossless and r._language in ("own0", "own1") for r in after)
    assert any(r.doc_id is None for r in after) and {r.source for r in after if r.doc_id is None} >= {"s0", "s1", "s2", "s9"}


def test_batches_of_long_documents_are_small(spark):
    """10,000 documents of the usual length would lie whole in the executor's memory and in the worker's."""
    docs = spark.createDataFrame(corpus(), SCHEMA)
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        corpus_pipeline.cut_repeats(spark, docs, "")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == corpus_pipeline.BATCH_ROWS <= 1000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)


def test_a_chunk_of_the_pipeline_is_small():
    """Executors have a few hundred MB beside the memory that earlier stages filled, for all their workers."""
    rng = random.Random(3)
    text = [" ".join(f"w{rng.randrange(5000)}" for _ in range(550)) for _ in range(64)]
    rows = corpus_pipeline.CHUNK_DOCS
    chunk = pa.table({"chunk": [0] * rows, "doc_id": range(rows), "text": [text[i % 64] for i in range(rows)]})
    tracemalloc.start()
    substrings._Plan(50, 6).index(chunk)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_workers_give_memory_back():
    def held():
        with open("/proc/self/status") as file:
            return next(int(line.split()[1]) for line in file if line.startswith("RssAnon"))

    blocks = [bytes(40_000) for _ in range(6000)]
    last = blocks.pop()
    full = held()
    del blocks
    common.give_back()
    assert len(last) and held() < full - 150_000
