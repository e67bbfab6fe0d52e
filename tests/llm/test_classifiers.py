import random
import zlib

import numpy as np

from waymark.llm import language_mix, toxicity


def test_language_held_out(spark, folder, prose):
    stems = {"en": ("the", "ing", "ow", "sh"), "fr": ("eau", "ou", "é", "ti"), "de": ("sch", "ei", "ü", "ung")}
    rows = [(i, prose(i, 60, stems[x]), x, None, None) for i, x in enumerate(list(stems) * 40)]
    rows += [(1000, None, None, None, None), (1001, "123 ... 456", "en", None, None), (1002, "", None, None, None), (None, prose(1, 30, stems["fr"]), None, None, None), (1003, prose(2, 50, stems["en"]) + " " + prose(3, 50, stems["de"]), None, None, None)]
    got = {r.doc_id: r for r in language_mix.op4_language_mix(spark, folder(extra=True, documents=rows)).collect()}
    assert len(got) == len(rows)
    for i, _, lang, _, _ in rows[:120]:
        assert got[i].lang_pred == lang and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred in ("en", "de") and 0.4 < got[1003].score < 0.7 and got[None].lang_pred == "fr"


def test_language_without_labels(spark, folder):
    rows = [(1, "some words", None, None, None)]
    assert [r.lang_pred for r in language_mix.op4_language_mix(spark, folder(documents=rows)).collect()] == ["und"]
    assert language_mix.op4_language_mix(spark, folder(documents=[])).collect() == []


def test_language_never_sees_the_held_out(spark, folder, prose):
    rows = [(i, prose(i, 30), "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else "en", None, None) for i in range(30)]
    assert {r.lang_pred for r in language_mix.op4_language_mix(spark, folder(documents=rows)).collect()} == {"en"}


def _dense(model, text):
    """The same inference with whole tables, a cell of each language at a time."""
    m, cell, count = len(model.languages), *language_mix.cells_of(text)
    table = np.tile(model.unseen, (language_mix.CELLS, 1))
    for c in range(language_mix.CELLS):
        for k in range(model.start[c], model.start[c + 1]):
            table[c, model.language[k]] += model.beyond[k]
    assert np.allclose(table.sum(0), 1)
    likely = table[cell]

    def expected(some):
        share = np.full(len(some), 1 / len(some))
        for _ in range(language_mix.ROUNDS):
            part = likely[:, some] * share
            fresh = (count[:, None] * part / part.sum(1, keepdims=True)).sum(0) / count.sum()
            still, share = np.abs(fresh - share).max() < language_mix.STILL, fresh
            if still:
                break
        return share, (count * np.log(likely[:, some] @ share)).sum()

    levels = [expected([k])[1] for k in range(m)]
    chosen, best, fine = [int(np.argmax(levels))], max(levels), language_mix.PENALTY * np.log(count.sum())
    for k in np.argsort(-expected(list(range(m)))[0], kind="stable").tolist():
        if k not in chosen:
            level = expected([*chosen, k])[1]
            if level - fine <= best:
                break
            chosen, best = [*chosen, k], level - fine
    return {model.languages[k]: float(s) for k, s in zip(chosen, expected(chosen)[0], strict=True)}


def test_language_against_whole_tables(spark, folder, prose):
    stems = {"en": ("the", "ing", "ow", "sh"), "fr": ("eau", "ou", "é", "ti"), "de": ("sch", "ei", "ü", "ung")}
    rows = [(i, prose(i, 60, stems[x]), x, None, None) for i, x in enumerate(list(stems) * 20)]
    model = language_mix.fit(spark.read.parquet(folder(documents=rows) + "/documents.parquet"))
    assert model.languages == ["de", "en", "fr"]
    mixed = " ".join(prose(900 + k, 50, x) for k, x in enumerate(stems.values()))
    long = " ".join(prose(500 + k, 3000, x) for k, x in enumerate(stems.values()))
    for text in [*(t for _, t, *_ in rows[:9]), mixed, long, "zzz qqq", "É"]:
        name, score, mixture = model.infer(text)
        want = _dense(model, text)
        assert mixture.keys() == want.keys() and all(abs(mixture[k] - want[k]) < 1e-9 for k in want), text[:40]
        assert score == mixture[name] == max(mixture.values())
    assert len(model.infer(long)[2]) == 3


def test_any_number_of_languages(spark, folder, prose, monkeypatch):
    """More languages than a task counts at once; repeated rows and a very long text get results like others."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = {f"l{k:03}": tuple(random.Random(k).choice(letters) + random.Random(k + 7).choice(letters) + random.Random(9 * k + j).choice(letters) for j in range(4)) for k in range(300)}
    rows = [(3 * k + j, prose(3 * k + j, 40, x), own, None, None) for k, (own, x) in enumerate(stems.items()) for j in range(3)]
    docs = spark.read.parquet(folder(documents=rows) + "/documents.parquet")
    monkeypatch.setattr(language_mix, "TABLES_AT_ONCE", 16)
    model = language_mix.fit(docs)
    assert len(model.languages) == 300 and (np.bincount(model.language, minlength=300) > 0).all()
    got = [r.language for r in language_mix.with_language(docs.unionAll(docs.limit(5)), model).collect()]
    assert sum(g.lang_pred == own for g, (_, _, own, *_) in zip(got, rows, strict=False)) > 0.95 * len(rows)
    assert got[-5:] == got[:5]
    assert model.infer(prose(77, 100_000, stems["l123"]))[0] == "l123"


def _toxic(spark, folder, prose, n=400):
    r, rows, labels = random.Random(1), [], []
    for i in range(n):
        bad, words = i % 4 == 0, prose(i, r.choice([10, 40, 80, 300, 1500])).split()
        for _ in range(3 * bad):
            words.insert(r.randrange(len(words)), r.choice(["grobnik", "vladerous", "stinkfep"]))
        rows.append((i, " ".join(words), None, None, None))
        labels.append((i, 0, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark, folder, prose):
    rows, labels = _toxic(spark, folder, prose)
    rows += [(9001, None, None, None, None), (9002, "", None, None, None), (9003, prose(1, 8_000), None, None, None), (None, "x", None, None, None)]
    labels += [(1, None, None), (None, 1, 1), (0, 0, 1)]
    got = {r.doc_id: r for r in toxicity.op3_toxicity(spark, folder(extra=True, documents=rows, labels=labels)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [got[i].predicted == (i % 4 == 0) for i in held]
    assert all(got[i].held_out for i in held) and sum(right) / len(right) > 0.9
    assert got[9001].score == got[9002].score and got[9003].predicted == 0


def test_toxicity_one_class(spark, folder):
    docs = [(1, "a", None, None, None), (2, "b", None, None, None)]
    assert [r.score for r in toxicity.op3_toxicity(spark, folder(documents=docs, labels=[(1, 0, 0)])).collect()] == [0.0, 0.0]
    assert toxicity.op3_toxicity(spark, folder(documents=[], labels=[])).collect() == []


def test_a_long_text_leaves_room_for_others(spark, folder, prose, monkeypatch):
    """Texts beyond the bound on what is learned from do not keep the rest out."""
    rows, labels = _toxic(spark, folder, prose)
    rows += [(5000 + k, prose(k, 4000), None, None, None) for k in range(6)]
    labels += [(5000 + k, 0, 0) for k in range(6)]
    d = folder(documents=rows, labels=labels)
    docs, told = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, told, most_chars=20_000_000)
    small = toxicity.fit(docs, told, most_chars=1_000_000)  # 4,000 characters of each text
    for m in (model, small):
        scores = {i: m.score(t) for i, t, *_ in rows[:100]}
        bad = [s for i, s in scores.items() if i % 4 == 0]
        good = [s for i, s in scores.items() if i % 4]
        assert sum(bad) / len(bad) > sum(good) / len(good) + 0.2
