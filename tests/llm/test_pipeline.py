import random
import zlib

from pyspark.sql import functions as F

from lineagelake.llm import toxicity


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from lineagelake.llm.queries import tokenizer_path

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "decontamination", "pii", "packing"]
    rng = random.Random(9)

    def words(n):
        return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))

    leak = words(30)
    texts = {i: words(40) for i in range(100)}
    bad = {i for i in texts if i % 10 == 3}
    for i in bad:
        texts[i] += " zzidiotzz " + words(5)
    texts[50], texts[60] = texts[40], texts[40] + " more"  # copies
    texts[70] += " " + leak
    texts[80] += " a@b.cc"
    docs = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(200, None, "en", None, None), (None, words(20), None, "s", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in bad)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = toxicity.score_toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    rejected = {r.doc_id for r in model.where("predicted = 1").collect()}
    assert rejected == bad
    gone = bad | {50, 60, 70}
    assert {r.doc_id for r in got} == {i for i, *_ in docs} - gone
    t = Tokenizer.from_file(tokenizer_path())
    ids = t.encode(texts[80].replace("a@b.cc", "[EMAIL]"), add_special_tokens=False).ids + [1]
    assert next(r.ids_crc32 for r in got if r.doc_id == 80) == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def test_stages_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    long = " ".join(f"w{i % 977}q{i}" for i in range(20_000))
    rows = [(1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, None, None, None, None), (2, None, None, None, None), (3, "", "", "", 0), (None, "only text", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels, bench = spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int"), spark.createDataFrame([(None, None)], "item_id long, text string")
    for name, docs in (("some", spark.createDataFrame(rows, schema).withColumns({"score": F.lit("x"), "matches": F.lit(1), "kept": F.lit(2)})), ("none", spark.createDataFrame([], schema))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        # Repeated rows are one document to the search for copies; all of them stay.
        want = {1: 2, 2: 2, 3: 1, None: 1} if name == "some" else {}
        assert {d: sum(r.doc_id == d and r.piece == 0 for r in got) for d in want} == want and (want or not got)
        assert all(r.offset + r.length <= 4096 for r in got)


def test_stages_against_plain_loops(spark, tmp_path):
    """The documents that each stage keeps, found by comparing all pairs and all windows."""
    import corpus_pipeline

    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(400)]
    words = lambda n: rng.choices(vocabulary, k=n)
    items = [" ".join(words(25)) for _ in range(3)]
    texts = []
    for i in range(120):
        base = texts[rng.randrange(len(texts))].split() if texts and i % 4 == 0 else words(60)
        for _ in range(rng.randint(0, 4) if i % 4 == 0 else 0):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        texts.append(" ".join(base) + (" " + items[i % 3] if i % 9 == 5 else ""))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    top = list(range(120))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    sets = [shingles(t) for t in texts]
    for a in range(120):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    want = {i for i in range(120) if find(i) == i}
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == want and 90 < len(want) < 115
    held = {i for i in want if any(x[s : s + 64] in texts[i] for x in items for s in range(len(x) - 63))}
    clean = corpus_pipeline.decontamination(spark, kept, str(tmp_path))
    assert {r.doc_id for r in clean.collect()} == want - held and len(held) > 5
