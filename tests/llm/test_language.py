import random

import pytest

from gleanery.llm import language as G

SENT = {
    "en": ["The {a} is held by the {b} when the device is closed.", "Without this measure the {a} would wear out after a short time.", "It was found that the {a} and the {b} should be cleaned every day."],
    "de": ["Die {a} wird von der {b} gehalten, wenn das Gerät geschlossen ist.", "Ohne diese Maßnahme würde die {a} nach kurzer Zeit verschleißen.", "Es hat sich gezeigt, dass die {a} und die {b} jeden Tag zu reinigen sind."],
    "fr": ["Le {a} est maintenu par le {b} lorsque le dispositif est fermé.", "Sans cette mesure, le {a} serait usé après peu de temps.", "On a constaté que le {a} et le {b} doivent être nettoyés chaque jour."],
    "es": ["El {a} se mantiene por el {b} cuando el dispositivo está cerrado.", "Sin esta medida, el {a} se gastaría tras poco tiempo.", "Se ha comprobado que el {a} y el {b} deben limpiarse todos los días."],
}
D = "doc_id long, text string, lang string"


def sentence(r, lang):
    w = lambda: "".join(r.choice(["ba", "tro", "nex", "li", "vor", "mu"]) for _ in range(3))
    return r.choice(SENT[lang]).format(a=w(), b=w())


def world(n=400):
    r = random.Random(2)
    docs, want = [], set()
    for i in range(n):
        lang = r.choice(list(SENT))
        paras = [" ".join(sentence(r, lang) for _ in range(3)) for _ in range(3)]
        label = r.choice([lang, lang.upper(), f"{lang}-XX", {"en": "English", "de": "ger", "fr": "fra", "es": "Spanish"}[lang]])
        if i % 10 == 0:
            other = r.choice([x for x in SENT if x != lang])
            paras[1] = " ".join(sentence(r, other) for _ in range(2))
            want |= {(i, 1, lang), (i, 2, other), (i, 3, lang)}
        elif i % 10 == 1:
            label = r.choice([None, "", "xx", "unknown", "nl", r.choice([x for x in SENT if x != lang])])
            want.add((i, -1, lang))
        docs.append((i, "Title without a stop\n\n" + "\n\n".join(paras), label))
    return docs, want


def test_labels_and_passages(spark):
    docs, want = world()
    df = spark.createDataFrame(docs, D)
    seg = G.segments(df, G.fit(df))
    assert {tuple(r) for r in G.wrong_labels(seg).collect()} == want
    rows = seg.collect()
    assert {r.doc_id for r in rows if r.par_no == -1} == {d[0] for d in docs} and all(0 <= r.confidence <= 1 for r in rows)


def test_held_out_accuracy(spark):
    docs, _ = world(600)
    train, held = docs[:300], docs[300:]
    model = G.fit(spark.createDataFrame(train, D))
    got = {r.doc_id: r.lang for r in G.segments(spark.createDataFrame(held, D), model).where("par_no = -1").collect()}
    clean = [d for d in held if d[0] % 10 > 1]
    right = sum(got[d[0]] == {"English": "en", "ger": "de", "fra": "fr", "Spanish": "es"}.get(d[2], d[2][:2].lower()) for d in clean)
    assert right / len(clean) > 0.99


def test_nulls_empty_long_and_extra_columns(spark):
    docs, _ = world(200)
    model = G.fit(spark.createDataFrame(docs, D))
    odd = [(1, None, "en"), (2, "", None), (3, "12 34 ... !!", "de"), (4, "Заголовок на другом языке без точки", "ru"), (5, " ".join(SENT["en"]).format(a="x", b="y") * 3000, "en"), (5, SENT["en"][0].format(a="x", b="y"), "en")]
    df = spark.createDataFrame([(*o, 1, 2) for o in odd], D + ", par_no int, t int")
    got = [(r.doc_id, r.lang) for r in G.segments(df, model).collect()]
    assert sorted(got) == [(1, "und"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (5, "en")]
    none = spark.createDataFrame([], D)
    assert G.fit(none) is None and G.segments(none, None).count() == 0 and G.segments(none, model).count() == 0
    assert G.fit(spark.createDataFrame([(1, "No label here at all.", None)], D)) is None


@pytest.mark.parametrize("label,code", [("en", "en"), ("EN-us", "en"), ("en_GB", "en"), ("ger", "de"), ("English", "en"), (" por ", "pt"), ("und", None), ("xx", None), ("-", None), ("", None), (None, None), ("unknown", None), ("Swahili", "sw"), ("isl", "is"), ("n/a", None)])
def test_label_codes(spark, label, code):
    assert G.with_label_code(spark.createDataFrame([(label,)], "l string"), G.F.col("l")).first()[0] == code


def test_any_language_can_be_learned(spark):
    """A language beyond the usual ones, and words that differ only far from their start."""
    long = {"sw": "Kifaa " + "ki" * 30 + "choma kinashikiliwa na mlango wakati mashine imefungwa.", "is": "Lok " + "ki" * 30 + "thera er haldið af festingu þegar tækið er lokað."}
    docs = [(i, " ".join([long[l]] * 3 + [f"{long[l][:-1]} {i}."]), l) for i in range(60) for l in [list(long)[i % 2]]]
    docs += [(100, long["is"], "swahili"), (101, long["sw"], None)]
    df = spark.createDataFrame(docs, D)
    assert {tuple(r) for r in G.wrong_labels(G.segments(df, G.fit(df))).collect()} == {(100, -1, "is"), (101, -1, "sw")}


def test_grams_reach_the_end_of_long_words():
    w = ["a" * 40 + "xyz", "a" * 40 + "xyw", "b" * 100_000, "c"]
    at, h = G.Features.grams(w)
    assert set(h[at == 0]) != set(h[at == 1]) and (at == 2).sum() == sum(100_002 - n + 1 for n in G.GRAMS)
    assert sorted(h[at == 3]) == sorted(G.Features.grams(["c"])[1])


def test_sentences():
    assert G.paragraphs("A\n\nB\r\n\r\n \n C\n") == ["A", "B", " C\n"]
    assert len(G.sentences("1. A device that holds the pump 2.5 mm away. It works well in the cold! No stop here")) == 2
