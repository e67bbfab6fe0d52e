import hashlib

import sentencepiece

import corpus_pipeline
from waymark.llm import common, sentencepiece_codec


def test_stages(spark, folder, prose):
    stems = {"en": ("the", "ing", "ow", "sh"), "fr": ("eau", "ou", "é", "ti")}
    docs = [(k, prose(k, 60, stems[x]), x, "ab"[k % 2], 1) for k, x in enumerate(["en", "fr"] * 20)]
    docs += [(100, docs[3][1] + " end", "fr", "a", 1), (101, "1234 5678", "en", "a", 1), (102, docs[5][1].upper().replace("É", "é"), "fr", "b", 1), (7, *docs[7][1:]), (103, prose(200, 60, stems["en"]) + " password=abcdefghijklmnop", "en", "b", 1)]
    d = folder(documents=docs)
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, d)
        rows = kept[name] = now.collect()
        if name != "sentencepiece":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = spark.createDataFrame(rows, now.schema)
    assert sorted(r.doc_id for r in kept["language_id"]) == sorted(i for i, *_ in docs if i != 101)
    assert sorted(r.doc_id for r in kept["ngram_join"]) == sorted([*range(40), 103])
    (cleaned,) = [r.text for r in kept["secret_scan"] if r.doc_id == 103]
    assert cleaned.endswith(" [secret]") and sum(r.text != dict((i, t) for i, t, *_ in docs)[r.doc_id] for r in kept["secret_scan"]) == 1
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    texts = {r.doc_id: r.text for r in kept["secret_scan"]}
    assert sorted(r.doc_id for r in kept["sentencepiece"]) == sorted(r.doc_id for r in kept["source_mix"])
    words = lambda t: len(t.split())
    assert abs(sum(words(r.text) for r in kept["source_mix"]) / (1.5 * sum(map(words, texts.values()))) - 1) < 0.1
    for r in kept["sentencepiece"]:
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, lib.encode(texts[r.doc_id], add_eos=True))).encode()).hexdigest()


def test_one_of_each_group_by_row(spark, folder, prose):
    a, b, c, d, e, f = (prose(k, 60, ("the", "ing", "ow", "sh")) for k in range(300, 306))
    near = [c, c + " end", c + " stop"]
    rows = [(1, a), (None, a), (None, b), (None, ""), (None, None), (5, d), (5, a + " end"), (5, e), (6, near[0]), (6, near[1]), (6, near[2]), (None, f), (None, f + " end"), (None, f), (7, e)]
    docs = spark.read.parquet(folder(documents=[(i, t, "en", "a", 1) for i, t in rows]) + "/documents.parquet")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    (one,) = [r for r in got if r[1] in near]
    (other,) = [r for r in got if r[1] in (f, f + " end")]
    assert one[0] == 6 and other[0] is None
    assert sorted(map(str, got)) == sorted(map(str, [(1, a), (None, b), (None, ""), (None, None), (5, d), (5, e), one, other]))


def test_columns_of_any_name_pass_through(spark, prose):
    """Columns that the operators use themselves come out as they went in; a brute-force run of the stages that keep rows."""
    docs = [(k, prose(k, 50, ("the", "ing", "ow", "sh")), "en", "ab"[k % 2], 1, 99 + k, "l", "q", k, f"r{k}", None) for k in range(40)]
    docs += [(None, prose(100, 50, ("the", "ing", "ow", "sh")), None, None, None, 7, None, None, None, None, None)]
    now = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, size long, _language string, _key string, _nth long, row string, salt int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        rows = now.collect()
        kept = {(r.doc_id, r.size, r._language, r._key, r._nth, r.row, r.salt) for r in rows}
        assert kept <= {(d[0], *d[5:]) for d in docs} and (len(kept) == len(docs) or name == "source_mix")
        now = spark.createDataFrame(rows, now.schema)


def test_dotted_names_and_maps(spark, prose):
    docs = [(k, prose(k, 50, ("the", "ing", "ow", "sh")), "en", "ab"[k % 2], 1, f"v{k}", {"m": k}, f"t{k}") for k in range(20)] + [(20, prose(1, 50, ("the", "ing", "ow", "sh")), "en", "a", 1, "v", None, "t")]
    now = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, m map<string,int>, `c``d` string")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.settled(stage(spark, now, ""))
        assert now.columns == columns and all(r["a.b"] in ("v", f"v{r.doc_id}") and (r.m is None or r.m == {"m": r.doc_id}) for r in now.collect())
        assert now.count() == 21 if name == "language_id" else now.count() == 20 if name != "source_mix" else now.count() > 10
    assert corpus_pipeline.encoded(spark, now, "").count() == now.count()


def test_folders_are_deleted(spark, folder, prose):
    since = common.mark()
    d = folder(documents=[(k, prose(k, 50, ("the", "ing", "ow", "sh")), "en", "a", 1) for k in range(30)])
    got = corpus_pipeline.run(spark, d)
    assert common.mark() - since == 1 and got.count() > 0


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder(documents=[])).collect() == []
