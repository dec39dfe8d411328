import corpus_pipeline
from entiquery.llm import shared, substrings

DIR = "/root/testdata/sf0.001"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark):
    """Each stage's effect on the whole small table, against brute force where the stage is exact."""
    docs = shared.table(spark, DIR, "documents")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in shared.table(spark, DIR, "labels").where("toxic = 1").collect()}
    frames = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.materialise(stage(spark, docs, DIR))
        assert docs.columns == columns
        frames.append({r["doc_id"]: r["text"] for r in docs.collect()})
    clean, single, cut, kept = frames
    # The table has some 80 labels: too few to learn every toxic word.
    assert set(clean) <= set(texts) and len(toxic & set(clean)) <= 0.5 * len(toxic) and len(clean) > 0.8 * (len(texts) - len(toxic))
    marks = {d: shingles(t) for d, t in clean.items()}
    root = {d: d for d in clean}
    for a in marks:
        for b in marks:
            if b < a and root[a] != root[b] and len(marks[a] & marks[b]) >= 0.8 * len(marks[a] | marks[b]):
                low, high = sorted((root[a], root[b]))
                root = {x: low if r == high else r for x, r in root.items()}
    assert set(root.values()) == set(single)
    seen = set()
    for d in sorted(single):
        raw, gone = single[d].encode(), set()
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone.update(range(s, s + 100))
            seen.add(raw[s : s + 100])
        assert cut[d] == bytes(b for i, b in enumerate(raw) if i not in gone).decode("utf-8", "ignore")
    assert set(kept) <= set(cut) and len(kept) > 0.8 * len(cut)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert {r["doc_id"] for r in rows} == set(kept)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= corpus_pipeline.CAPACITY


def small_world(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, __uid long, length int, size string, uid int, piece string").write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, small_world(spark, tmp_path, [])).count() == 0


def test_odd_documents(spark, tmp_path):
    """Nulls, empty and repeated rows, a long text, ties and columns of any name go through all stages."""
    long = " ".join(f"word{i * 7919 % 100003}" for i in range(60000))
    texts = [None, "", " \n", "one", "one", long, long + " more", "plain words that stand here alone and say nothing", None]
    rows = [(None if i in (1, 8) else 10**6 + min(i, 6), t, "en", i, 3, "s", None, "p") for i, t in enumerate(texts)]
    folder = small_world(spark, tmp_path, rows)
    docs = shared.table(spark, folder, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.materialise(stage(spark, docs, folder))
        assert docs.columns == columns, name
    kept = docs.collect()
    assert sorted(r["__uid"] for r in kept if r["text"] and r["text"].strip()) == [3, 5, 7]  # one of each group
    assert sum(not (r["text"] or "").strip() for r in kept) == 1 and all(r["size"] == "s" and r["length"] == 3 for r in kept)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in kept}
    assert sum(r["length"] for r in pieces if r["doc_id"] == 10**6 + 5) > 60000


def test_run_equals_stages(spark):
    rows = corpus_pipeline.run(spark, DIR)
    assert rows.count() > 0 and set(rows.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    assert substrings.LENGTH == 100
