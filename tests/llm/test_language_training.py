"""No language with a labelled document to learn from is left out of training."""

import zlib

import pytest

from epispan.llm import language
from epispan.llm.common import prepared

TEXTS = {
    "aa": "the water runs down to the river and the wind goes over the hill ",
    "bb": "der wald steht still und die nacht kommt schnell herunter ",
    "cc": "la lune monte au ciel et les oiseaux dorment dans les arbres ",
}
DDL = "doc_id bigint, text string, lang string"


def ids_of(fold, aside=None):
    for i in range(100_000):
        crc = zlib.crc32(str(i).encode())
        if crc % 3 == fold and (aside is None or (crc // 3 % language.ASIDE == 0) == aside):
            yield i


@pytest.mark.parametrize("aside", [True, False])
@pytest.mark.parametrize("fold", [0, 2])
def test_language_with_one_document_is_learned(spark, fold, aside):
    common, held = ids_of(0), ids_of(1)
    rows = [(next(common), TEXTS["aa"] * 3, "aa") for _ in range(20)]
    own = [i for i, _ in zip(ids_of(fold, aside), range(60), strict=False) if i not in {r[0] for r in rows}][-1]
    rows += [(own, TEXTS["bb"] * 3, "bb"), (next(held), TEXTS["bb"], None)]
    frame = prepared(spark).createDataFrame(rows, DDL)
    model = language.train(frame)
    assert model.languages == ["aa", "bb"]
    got = {r.doc_id: r.lang_pred for r in language.predict(frame, model).collect()}
    assert got[own] == got[rows[-1][0]] == "bb"


def test_language_of_few_long_documents_does_not_vanish(spark):
    ids = [i for i, _ in zip(ids_of(0), range(24), strict=False)]
    rows = [(i, TEXTS[lang] * 400, lang) for k, lang in enumerate(TEXTS) for i in ids[8 * k : 8 * k + 8]]
    frame = prepared(spark).createDataFrame(rows, DDL)
    for letters in (1, 100, 30_000):
        model = language.train(frame, letters=letters, calibration_letters=100)
        assert model.languages == sorted(TEXTS)


def test_letters_of_a_language_are_bounded_and_reached(spark):
    rows = prepared(spark).range(20_000).selectExpr("'aa' as lang", "pmod(xxhash64(id), 1000000007) / 1000000007 as place", "50L as n")
    upto = {r.lang: r.upto for r in language.reach(rows, 100_000).collect()}
    letters = 50 * rows.where(f"place <= {upto['aa']!r}").count()
    assert 100_000 <= letters <= 110_000


def test_calibration_takes_no_more_than_its_letters(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language, "fit", lambda counted: seen.update(counted=counted))
    monkeypatch.setattr(language, "calibrate", lambda model, labelled: seen.update(labelled=labelled))
    ids = [i for i, _ in zip(ids_of(2), range(400), strict=False)]
    frame = prepared(spark).createDataFrame([(i, TEXTS["aa"], "aa") for i in ids], DDL)
    language.train(frame, calibration_letters=500)
    letters = seen["labelled"]["text"].str.len().sum()
    assert 500 <= letters <= 700
    # all other documents are learned from: each of them ends the word "hill" once
    learned = seen["counted"].set_index("gram")["n"]["ill "]
    assert learned == 400 - len(seen["labelled"])
