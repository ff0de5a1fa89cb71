import random
import zlib

import numpy as np
import pytest

from vecpress.llm import language_id

SCHEMA = "doc_id long, text string, lang string"


def _plain(net, text):
    """Language and score of one text, window by window and filter by filter."""
    data = (text or "").encode()
    if net is None or not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    total = np.zeros(len(net.languages))
    for i in range(0, len(data), 256):
        window = data[i : i + 256]
        padded = np.frombuffer(window.ljust(256, b"\0"), np.uint8)
        features = []
        for width, filters, bias in zip(language_id.WIDTHS, net.filters, net.bias, strict=True):
            places = [sum(filters[k][padded[j + k]].astype(float) for k in range(width)) + bias for j in range(256 - width + 1)]
            features.append(np.maximum(np.max(places, axis=0), 0))
        z = np.concatenate(features) @ net.dense + net.dense_bias
        p = np.exp(z - z.max())
        total += p / p.sum() * len(window)
    total /= total.sum()
    return net.languages[int(total.argmax())], float(total.max())


def _texts(n, seed=3):
    rng = random.Random(seed)
    words = {"en": "the of and to in is that for it with as was on".split(), "fr": "le de un et est en que qui dans pour pas sur".split()}
    return [(lang, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 400)))) for lang in ("en", "fr") for _ in range(n)]


def test_predictions_equal_a_plain_version(spark):
    rows = _texts(40)
    net = language_id.fit(spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], SCHEMA), language_id.held_out() | True)
    tables = net.tables()
    texts = [t for _, t in rows[::7]] + ["é" * 700, "x", "x" * 256, "y" * 257, "1 2 3", None, "", "\ud7ff\u4e2d " * 200, "the " * 5000]
    got = language_id.predict_texts(net, tables, [None if t is None else t.encode() for t in texts])
    for t, (lang, score) in zip(texts, got, strict=True):
        want, p = _plain(net, t)
        assert lang == want and score == pytest.approx(p, abs=1e-4)


@pytest.mark.parametrize("doc_id", [None, next(i for i in range(99) if zlib.crc32(str(i).encode()) % 4 != 2)])
def test_rows_without_ids_of_their_own_are_learned(spark, doc_id):
    docs = spark.createDataFrame([(doc_id, t, lang) for lang, t in _texts(300)], SCHEMA)
    if doc_id is not None:
        assert not docs.select(language_id.held_out()).first()[0]
    got = language_id.identify(docs, ["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.97 * len(got)


def test_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    seen = []
    plain = language_id.train
    monkeypatch.setattr(language_id, "train", lambda rows, labels, names: seen.append((len(rows), names)) or plain(rows, labels, names, epochs=1))
    copies = [(None, "the same words again and again", "en")] * 3000
    rows = copies + [(i, t, lang) for i, (lang, t) in enumerate(_texts(200))] + [(i, f"le mot {i}", f"junk{i}") for i in range(40)]
    language_id.fit(spark.createDataFrame(rows, SCHEMA), language_id.held_out() | True, per_language=50, languages=3)
    (n, names), = seen
    assert {"en", "fr"} < set(names) and len(names) == 3
    assert n <= 3 * 50 * language_id.WINDOWS and n > 50 * language_id.WINDOWS


def test_empty_texts_train_nothing(spark):
    docs = spark.createDataFrame([(1, "", "en"), (2, None, "fr"), (3, "words", None)], SCHEMA)
    assert {tuple(r) for r in language_id.identify(docs, ["doc_id"]).select("lang_pred", "score").collect()} == {("und", 0.0)}
