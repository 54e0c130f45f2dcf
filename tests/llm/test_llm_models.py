"""Trained and scoring operators: accuracy, exact bases, round trips."""
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
from llm_helpers import WORD, lower, remainder
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiflow.llm import context_tree, language_id, toxicity
from lexiflow.llm.common import id_remainder
from lexiflow.llm.html_text import extract, main_text
from lexiflow.llm.packing import Schedule, pack
from lexiflow.llm.sanitize import joined, sanitize

EN = "the cat and the dog went to the house of the man with a hat"
DE = "der hund und die katze gehen in das haus von dem mann mit hut"


def labelled(spark):
    rows = []
    for i in range(80):
        base, lang = (EN, "en") if i % 2 else (DE, "de")
        toxic = int(i % 4 < 2)
        words = base.split()
        text = " ".join(words[i % 5:] + (["you", "dreadful", "numbskull"] if toxic else ["good"])) + ". " + base + "."
        rows.append((i, text, lang, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_language_id(spark, odd, none):
    docs = labelled(spark)
    model = language_id.fit(docs.where(id_remainder(3) != 1))
    got = language_id.predict(docs, model).where(id_remainder(3) == 1).collect()
    assert got and all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    other = language_id.predict(odd, model)
    assert other.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"]
    by_text = {r.text: (r.lang_pred, r.score) for r in other.collect()}
    assert by_text[None] == by_text[""] == by_text["1234 5678"] == ("und", 0.0)
    empty = language_id.fit(none)
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0


def test_toxicity_tolerates_gaps(spark, odd, none):
    docs = labelled(spark)
    labels = docs.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(id_remainder(5) != 0))
    got = toxicity.score(docs, model).where(id_remainder(5) == 0).collect()
    assert got and all(r.predicted == r.toxic for r in got)
    said = ["a numbskull", "a numb-skull", "a numbbskull", "a n u m b s k u l l here", "a hat and house", None, ""]
    p = [r.score for r in toxicity.score(spark.createDataFrame([(i, t) for i, t in enumerate(said)], "doc_id long, text string"),
                                         model).orderBy("doc_id").collect()]
    assert all(0 <= x <= 1 for x in p) and min(p[:4]) > max(p[4:]) and p[5] == p[6]
    assert toxicity.score(odd, model).count() == 15 and toxicity.score(none, model).count() == 0
    alone = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, alone).collect()} == {0.0}


def test_packing_is_an_exact_cover(spark, odd, odd_rows, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for size, options in ((64, {}), (16, {"block_windows": 3, "mixture": {"a": 0.7, "b": 0.3}}), (50, {"max_queues": 2})):
        rows = pack(odd, path, size=size, quantum=4, **options).collect()
        fill = {}
        for r in rows:
            assert r.length == len(r.ids) > 0
            fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for s, parts in fill.items():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at == size or s == max(fill)
        assert sorted(fill) == list(range(len(fill)))
        want = Counter()
        for doc_id, text, *_ in odd_rows:
            want[doc_id] += len(tok.encode(text or "", add_special_tokens=False).ids) + 1
        got = Counter()
        for r in rows:
            got[r.doc_id] += r.length
        assert got == want
        one = sorted((r for r in rows if r.doc_id == 6), key=lambda r: r.start)
        ids = [i for r in one for i in r.ids]
        assert ids == tok.encode(odd_rows[5][1], add_special_tokens=False).ids + [2]
    assert pack(none, path).count() == 0


def test_schedule_keeps_proportions_and_deficits():
    plan = Schedule([50_000, 30_000, 1_000, 19_000], None, 1000, 10, 8)
    share = np.array([0.5, 0.3, 0.01, 0.19])
    before = np.zeros(4)
    for b in range(plan.blocks):
        given, offset = plan.block(b)
        assert (np.diff(given, axis=0) >= 0).all() and (given[0] == before).all()
        for w in range(len(offset)):
            t = given[w + 1].sum()
            assert np.abs(given[w + 1] - share * t).max() <= 9  # less than the quantum and a token
        before = given[-1]
    assert list(before) == [50_000, 30_000, 1_000, 19_000]


def test_context_tree_base_and_distribution(spark, odd, odd_rows, none):
    learn = id_remainder(7) != 2
    got = context_tree.score(odd, learn, keep={"doc_id": F.col("doc_id"), "text": F.col("text")}, hot_words=5).collect()
    counts = Counter()
    for doc_id, text, *_ in odd_rows:
        if remainder(doc_id, 7) != 2:
            counts.update([*WORD.findall(lower(text)), None])
    total, distinct = sum(counts.values()), len(counts)
    assert len(got) == len(odd_rows)
    for r in got:
        words = [*WORD.findall(lower(r.text)), None]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert context_tree.score(none, learn).count() == 0


def test_context_tree_mixture_sums_to_one():
    rng = np.random.default_rng(1)
    counts = np.zeros((64,) * 4, np.float32)
    at = rng.integers(0, 6, (500, 4))
    np.add.at(counts, tuple(at.T), 1)
    m = context_tree.Mixture(counts)
    assert np.allclose((10.0 ** m.table).sum(1), 1, atol=1e-4)
    assert m.row.min() >= 0 and m.row.max() < len(m.table)
    # the two-symbol case by the textbook recursion at the root decision
    lg = math.lgamma
    for a, b in ((3.0, 0.0), (7.0, 12.0)):
        want = lg(a + .5) + lg(b + .5) - lg(a + b + 1) - math.log(math.pi)
        assert math.isclose(context_tree.estimate(np.array([a]), np.array([b]))[0], want, rel_tol=1e-8)


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 16 <= len(d) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 8 <= len(d) <= 15),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def test_personal_data_equals_plain_patterns(spark, odd, none):
    hard = ["a@b.co_x@d.ef", "x@y", "1.2.3.4.5.6.7.8", "001.002.003.004 256.1.1.1 1.1.1", "4111-1111-1111-1111 4111 1111 1111 1112",
            "+1 ((((", "+12345678 +1234567", "éé a.b@c-d.e.f, ü +49 (30) 123-456 7", "9" * 400, None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(hard)], "doc_id long, text string")
    got = {r.doc_id: r for r in sanitize(docs).select("doc_id", joined(F.col("base")).alias("b"), "sanitised").collect()}
    for i, text in enumerate(hard):
        want = []
        for kind, (pattern, ok) in KINDS.items():
            for m in re.finditer(pattern, text or ""):
                if ok(m[0], re.sub("[^0-9]", "", m[0])):
                    want.append(f"{kind}:{m.start()}:{m.end()}")
        assert got[i].b == ",".join(want), text
    assert got[7].sanitised == "éé <email>, ü <phone>"
    assert sanitize(odd).count() == 15 and sanitize(none).count() == 0


def test_disclosing_words_by_brute_force(spark):
    rows = [(i, f"filler{i} one two codename zorro{i % 2} a{i}@b.com tail end more") for i in range(8)]
    rows += [(100 + i, "one two tail end more words of filler text without any such thing") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sanitize(docs, reach=3, support=5).select("doc_id", joined(F.col("spans")).alias("s"), "sanitised").collect()}
    # "codename" is only ever seen near an address; "zorro0" is too rare, the others are common
    text = rows[0][1]
    at = text.index("codename")
    assert f"term:{at}:{at + 8}" in got[0].s and got[0].s.count("term") == 1
    assert got[0].sanitised == "filler0 one two  zorro0 <email> tail end more"
    assert got[100].s == "" and got[100].sanitised == rows[8][1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href="/a>b">Menu</a></li></ul></nav><div class="ad">Buy the best of the things in the shop now.</div>
<article><h1>Short title</h1><p><b>First &amp; foremost&nbsp;the text of<br>this <p>Les.</p>
<div id="comments"><p>The reader said that this is the best of all the texts that he has read.</p></div></article>
<aside>side</aside><footer>&copy; the owner of the page</footer>"""


def test_html_main_text(spark, none):
    assert extract(PAGE) == "Short title First & foremost the text of this Les."
    assert extract(None) == extract("") == "" and extract("<p>" * 50 + "<!--") == ""
    bare = "<p><a href=x>Home</a> <a href=y>News</a></p>" + "<p>" + "the man of the house was in the garden with it. " * 5 + "</p><p>Short.</p>"
    assert extract(bare).startswith("the man") and "Home" not in extract(bare)
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 6), (1, "u", PAGE, 5)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.n_chars, len(r.text)) for r in main_text(pages).collect())
    assert got[0] == got[1] and got[0][1] == got[0][2] and got[2] == (2, 0, 0)
    assert main_text(pages.limit(0)).count() == 0


def test_html_languages_and_regions():
    ru = "Вчера вечером жители города собрались на площади, чтобы обсудить новый мост через реку и дорогу."
    pl = "Wczoraj wieczorem mieszkańcy miasta zebrali się przed ratuszem, żeby omówić budowę nowego mostu przez rzekę."
    zh = "昨天晚上市民聚集在广场上讨论新桥的建设计划，市长说工程将在明年春天开始，预计需要两年时间才能完成。"
    en = "The council said that it was to meet in the town hall and that the bridge is for all of the people."
    menu = "<div><a href='/'>Home</a> <a href='/n'>News</a></div>"
    for text in (ru, pl, zh):
        assert extract(f"<body>{menu}<div><p>{text}</p><p>{text}</p></div>{menu}</body>") == f"{text} {text}"
    # the language of a short notice is not the page's
    assert extract(f"<body>{menu}<div>{en}</div>{menu}<p>{pl}</p><p>{pl}</p>{menu}</body>") == f"{en} {pl} {pl}"
    aside = "<aside><article>Teaser of a story</article><article>Another teaser</article></aside>"
    assert extract(f"<body>{menu}<div><p>{en}</p><p>{en}</p></div>{aside}</body>") == f"{en} {en}"
    beside = "<article>Teaser of a story</article>"
    assert extract(f"<body>{beside}<div><p>{en}</p><p>{en}</p></div>{menu}</body>") == f"{en} {en}"
    # a page wrapped in a form has no other text
    assert extract(f"<body><form>{menu}<main><p>Short line</p><p>{en}</p></main></form></body>") == f"Short line {en}"
    # an article keeps its short lines and leaves out what stands beside it
    assert extract(f"<article><p>{en}</p><p>Short line</p></article><div>Something else</div>") == f"{en} Short line"
