"""The pipeline's stages, each on its own input."""

import re

import public_tokenizers

import corpus_pipeline
from palisade.llm import op1_toxicity, op3_secrets, op4_decontaminate, op5_jaccard_join, op8_sentencepiece, registry


def test_registry():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench, labels = spark.read.parquet(f"{data}/benchmark.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    columns, ids = docs.columns, lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, data)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "toxicity":
            assert ids(docs) == {r.doc_id for r in op1_toxicity.score(before, labels).where("predicted = 0").collect()}
        elif name == "ngram_jaccard_join":
            assert ids(docs) == {r.doc_id for r in op5_jaccard_join.link_components(before, 5, 80).where("n_shingles = 0 or doc_id = component_id").collect()}
        elif name == "benchmark_decontamination":
            assert ids(docs) == {r.doc_id for r in op4_decontaminate.report(before, bench).where("not contaminated").collect()}
        else:
            assert ids(docs) == ids(before)
        assert docs.columns[:5] == columns and (name == "sentencepiece") == (len(docs.columns) > 5)
    assert docs.where("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0


def test_run_against_brute_force(spark, data):
    """Plain Python over the same documents; only the learned scores are taken from op1."""
    import sentencepiece

    docs = spark.read.parquet(f"{data}/documents.parquet")
    clean = {r.doc_id for r in op1_toxicity.score(docs, spark.read.parquet(f"{data}/labels.parquet")).where("predicted = 0").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in clean}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]) and root[x] != root[y]:
                low, high = sorted((root[x], root[y]))
                root = {k: low if v == high else v for k, v in root.items()}
    texts = {i: t for i, t in texts.items() if root[i] == i or not sets[i]}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    held = set()
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = word.findall((r.text or "").translate(lower))
        held |= {tuple(w[j : j + min(13, len(w))]) for j in range(max(len(w) - 12, 1))} if w else set()
    sizes = {len(g) for g in held}
    for i, t in list(texts.items()):
        w = word.findall(t.translate(lower))
        hit = {p for k in sizes for j in range(len(w) - k + 1) if tuple(w[j : j + k]) in held for p in range(j, j + k)}
        if hit and 20 * len(hit) >= len(w):
            del texts[i]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(op8_sentencepiece.MODEL))
    want = {}
    for i, t in texts.items():
        spans = sorted((m.start(), k, m.end()) for k, r in enumerate(op3_secrets.RULES) for m in re.finditer(r.pattern, t, re.A) if len(m[r.group]) >= r.least)
        at, out = 0, ""
        for a, _, b in spans:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        found = library.encode(out + t[at:])
        want[i] = (library.decode(found), found)
    rows = corpus_pipeline.run(spark, data).collect()
    assert len(rows) > 100 and {r.doc_id: ((r.text or ""), (r.token_ids or [])) for r in rows} == want


def test_odd_rows(spark, odd, data, tmp_path):
    """Null, empty, repeated and very long rows go through every stage with their columns."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns[: len(odd.columns)] == odd.columns
    # Of the two very long copies and of the repeated row one stays.
    assert sorted(r.doc_id or -1 for r in docs.collect()) == [-1, 1, 2, 3, 4, 4, 5, 6]


def test_jaccard_takes_five_words_and_four_fifths(spark, data):
    words = [f"w{i}" for i in range(104)]
    texts = [" ".join(words), " ".join(words + [f"x{i}" for i in range(25)]), " ".join([f"y{i}" for i in range(104)]), " ".join([f"y{i}" for i in range(104)] + [f"z{i}" for i in range(26)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # 100 of 125 shingles are shared, then 100 of 126.
    assert sorted(r.doc_id for r in corpus_pipeline.jaccard(spark, docs, data).collect()) == [0, 2, 3]
