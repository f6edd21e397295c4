"""Documents in no learned language, with any number of learned ones."""

import random

import pytest

from hitledger.llm import language

SYLLABLES = {
    "en": "the ing and ion ent her that ough wh sh th ed ly".split(),
    "de": "sch ich ein und der cht keit ung zu ge ver lich ß".split(),
    "fr": "eau oux que ais ent ment oi ç é è tion ou les".split(),
    "es": "ción que ado ñ los mente ía ue ll rr ndo os a".split(),
    "xx": "kvaa ypp jök uull hwy ggw zsz dzs őr űk pwl mbq yy".split(),
}


def text(name, seed, words=60):
    rng = random.Random(f"{name}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[name]) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.mark.parametrize("learned", [2, 3, 4])
def test_unlearned_languages_go(spark, documents_of, learned):
    names = ["en", "de", "fr", "es"][:learned]
    model = language.train({n: [text(n, i) for i in range(60)] for n in names})
    rows = [(1000 * k + i, text(n, 5000 + i, 5 + 4 * i)) for k, n in enumerate(names) for i in range(40)]
    rows += [(9000 + i, text("xx", i)) for i in range(40)] + [(9500, "jxqv zkw qqx vvj " * 20), (9501, "日本語の文です。" * 9), (9502, None), (9503, "12 !!")]
    kept = {r.doc_id for r in language.keep_identified(documents_of(rows), model).collect()}
    assert not [d for d in kept if d >= 9000]
    assert len(kept) >= 0.98 * 40 * learned
