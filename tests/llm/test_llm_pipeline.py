"""The corpus run, and every operator's query, on a small table."""

import hashlib
import re

import corpus_pipeline
import public_tokenizers
import sentencepiece
from test_llm_dedup import linked, removed

from paywright.llm import decontaminate, quality
from paywright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_act_and_keep_columns(spark, tmp_path):
    docs = corpus_pipeline.table(spark, SF, "documents")
    before, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == before
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > sizes[4] == sizes[5]
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


def test_run_equals_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, stated plainly; then the rows of the whole run."""
    read = lambda name: {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / name)).collect()}
    docs, kept = corpus_pipeline.table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs, kept[name] = spark.read.parquet(str(tmp_path / name)), read(name)
    texts = {r["doc_id"]: r["text"] for r in corpus_pipeline.table(spark, SF, "documents").collect()}
    scores = quality.score(corpus_pipeline.table(spark, SF, "documents"), corpus_pipeline.table(spark, SF, "labels")).collect()
    good = {r["doc_id"]: texts[r["doc_id"]] for r in scores if r["score"] >= 0.3 and texts[r["doc_id"]]}
    assert kept["quality"] == good
    groups = linked(list(good.items()))
    distinct = {d: t for d, t in good.items() if groups[d][1] == d}
    assert kept["near-duplicates"] == distinct
    cut = {d: v[4].decode("utf-8", "ignore") for d, v in removed(list(distinct.items()), 100).items()}
    assert kept["repeated-text"] == {d: t for d, t in cut.items() if t}
    words = lambda t: re.findall(r"\w+", t.lower())
    items = [words(r["text"]) for r in corpus_pipeline.table(spark, SF, "benchmark").collect() if words(r["text"])]
    whole = {d for d, t in kept["repeated-text"].items() if any(" ".join(i) in " ".join(words(t)) for i in items)}
    gone = set(kept["repeated-text"]) - set(kept["decontamination"])
    assert whole <= gone
    for d in gone:
        assert max(decontaminate.common_words(i, words(kept["repeated-text"][d])) / len(i) for i in items) >= decontaminate.SHARE_WITH_ANSWER
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for d, t in kept["decontamination"].items():
        ids = library.encode(t)
        want[d] = (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_all_stages_run_again_in_one_application(spark):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = [sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(3)]
    assert rows[0] == rows[1] == rows[2] and rows[0]
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"))


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "some text here", "en", "s", 14), (3, "x y z " * 60, None, None, None), (3, "x y z " * 60, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= 6
        stage(spark, docs.limit(0), SF).count()


def test_queries_cover_whole_tables(spark):
    count = {t: corpus_pipeline.table(spark, SF, t).count() for t in ("documents", "embeddings", "pages")}
    conversations = corpus_pipeline.table(spark, SF, "conversations").select("conv_id").distinct().count() + 1
    for name, query in QUERIES.items():
        want = count["embeddings" if name.startswith("op2_") else "pages" if name.startswith("op4_") else "documents"]
        got = query(spark, SF).count()
        want = conversations if name.startswith("op12_") else want
        assert got > 0 if name.startswith(("op1_", "op11_")) else got == want, name
