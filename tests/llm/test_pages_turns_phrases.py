"""HTML extraction, conversation repair and phrase mining on small cases and against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from helpers import rows
from threadloom.llm import conversation_repair as cr
from threadloom.llm import html_extraction as hx
from threadloom.llm import phrase_mining as pm

# HTML

PLAIN = hx.Weights()


def text(page, weights=PLAIN):
    return hx.main_text(page, weights)


def test_whole_article_and_nothing_else():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body class='has-sidebar'>"
        "<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'>We use cookies here.</div>"
        "<article><header><h1>Title &amp; more</h1><span>by someone</span></header><p>First  <b>bold</b>\n text.<br>Second line.<p>Next &copy; &#8364;"
        "<div class=ad>Buy now</div><form><input value=x>Your mail <button>Send</button></form><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>"
        "<aside>Related things</aside></article><section id=comments><article class=comment><p>I disagree with all of it, at great length.</p></article></section>"
        "<div class='sidebar'>Side words</div><footer>&copy; Site</footer></body></html>"
    )
    assert text(page) == "Title & more\nFirst bold text. Second line.\nNext © €\none\ntwo\na\nb"


def test_pages_without_a_mark():
    words = "words that belong to a longer text " * 5
    body = f"<div class=post><h2>Head</h2><p>{words}</p><p>{words}</p></div>"
    page = f"<body><div id=top-menu>Start here</div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><div><div>x</div></div>{body}<div><div><div>tiny</div></div></div><div class=comments>{words * 9}</div></body>"
    assert text(page) == "\n".join(["Head", words.strip(), words.strip()])


def test_wrappers_and_menus_left_open():
    assert text("<form id=all><div class='header-wrap'><article><p>kept</p></article></div></form>") == "kept"
    assert text("<nav><a href=x>menu</a><article><p>kept</p></article>") == "kept"
    assert text("<main><p>kept</p></main><div class=related><article>teaser words of another page</article></div>") == "kept"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("<!-- never closed <p>a</p>", ""), ("a < b and 1<2", "a < b and 1<2"), ("<p>x</p><script>y", "x"), ("<p>one</p><p cla", "one"),
        ("<p title='a>b'>x</p>", "x"), ("<p>a<!-->b<!--c-->d</p>", "abd"), ("<p>&ampamp; &am &nbsp;x&#x41;&#0;</p>", "&amp; &am xA�"), ("<P>A</P></p>B", "A\nB"), ("<p>a</p><? b ><p>c</p>", "a\nc"),
        ("<p hidden>x</p><p style='display: none'>y</p><p>z</p>", "z"),
    ],
)
def test_defined_cases(page, want):
    assert text(page) == want


def test_region_is_the_best_contiguous_one():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.randint(-4, 4) for _ in range(rng.randrange(12))]
        a, b = hx.region([float(x) for x in s])
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)), default=0)
        assert sum(s[a:b]) == max(best, 0)


def test_weights_have_their_signs():
    learned = hx.Weights({"#word": (1000, 10), "#link": (1, 500), "p": (300, 0), "div": (0, 400)})
    assert learned.of("#word") > 0 > learned.of("#link") and -0.1 < learned.of("p") < 0 and learned.of("div") < -3 + 0.5 and learned.of("#out") == 0
    labelled = hx.label("<nav><a>x</a></nav><article><p>a b c</p></article>")
    assert labelled["#word", True] == 3 and labelled["nav", False] == 2 and not any(k in ("article", "main") for k, _ in labelled)


def test_deep_and_long_pages_take_linear_time():
    assert text("<div>" * 100_000 + "x" + "</span>" * 100_000) in ("x", "")
    assert text("<article>" + "<p>word " * 100_000).count("\n") == 99_999
    assert text("<article>" + "<a ='" * 20_000) == ""


def test_extract_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    pages = spark.createDataFrame([(1, "u", "<article>a</article>", "t", "n"), (1, "u", "<article>a</article>", "t", "n"), (None, None, None, None, None)], schema)
    got = hx.extract(pages, hx.fit(pages)).collect()
    assert sorted(map(str, got)) == sorted(map(str, [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)])) or [tuple(r) for r in got].count((1, "u", "a", 1)) == 2
    assert hx.extract(pages.limit(0), hx.fit(pages.limit(0))).count() == 0


# Conversations


def cheapest_by_hand(rows_, inserts=3):
    """The least (cost, audit) over all edit sequences with up to so many insertions."""
    best = []

    def go(i, state, cost, audit, left):
        if best and cost > best[0][0]:
            return
        if i == len(rows_) and state in (0, 3):
            best[:] = [min([*best, (cost, audit)])]
        if left:
            go(i, cr.NEXT[state], cost + 5, audit + "I", left - 1)
        if i < len(rows_):
            initial, fault = rows_[i]
            go(i + 1, state, cost + 2, audit + "D", left)
            if fault not in (1, 2):
                more = 5 * (fault == 3)
                go(i + 1, cr.NEXT[state], cost + 1 + more, audit + "R", left)
                if initial in cr.AFTER[state]:
                    go(i + 1, cr.AFTER[state][initial], cost + more, audit + "K", left)

    go(0, 0, 0, "", inserts)
    return best[0]


def test_search_and_pieces_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        given = [(rng.choice(["s", "u", "a", "u", "a", "x", ""]), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(7))]
        want = cheapest_by_hand(given)
        for size in (1, 2, 7):
            sources = {0: cr._Path(0, "", None)}
            parts = [given[k : k + size] for k in range(0, len(given), size)] or [[]]
            for k, part in enumerate(parts):
                ends = cr.cheapest(part, sources, k == len(parts) - 1)
                sources = {s: cr._Path(cost, sources[at].audit + audit, None) for s, (cost, audit, at) in ends.items()}
            (path,) = sources.values()
            assert (path.cost, path.audit) == want


def conversation(spark, given):
    schema = "conv_id long, turn long, role string, text string, fault string"
    return spark.createDataFrame([(*r, "clash") for r in given], schema)


def as_turns(spark, given):
    from pyspark.sql import functions as F

    return cr.repair(cr.faults(conversation(spark, given).withColumn("gone", F.lit(False)).fillna(" ", ["role", "text"])))


def test_repairs(spark):
    got = {
        r["conv_id"]: r
        for r in as_turns(
            spark,
            [
                (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."),
                (2, 3, "user", "Hi."), (2, 5, "user", "Hi."), (2, 6, "assistant", "Cut off"),
                (3, None, "system", "S."), (3, 1, None, "What?"), (3, 2, "assistant", " "),
                (None, 1, "assistant", "A."), (None, 1, "assistant", "A."),
            ],
        ).collect()
    }
    digest = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "KK", digest("user:Hi.", "assistant:Yes."))
    assert tuple(got[2])[1:] == (1, 0, 1, 1, 1, 6, "DDD", digest())  # keeping two turns of three would cost 2 + 5
    assert tuple(got[3])[1:] == (0, 1, 0, 0, 2, 4, "RRD", digest("user:S.", "assistant:What?"))
    assert got[None]["duplicate"] == 1 and got[None]["cost"] == 4 and got[None]["audit"] == "DD"


def test_long_conversation_streams_in_pieces(spark):
    rng = random.Random(5)
    given = [(9, k, rng.choice(["user", "assistant", "other"]), f"text {k}" + rng.choice([".", ".", "!", ""])) for k in range(3000)]
    (got,) = as_turns(spark, given).collect()
    codes = [(r[2][0], 0 if r[3][-1] in ".!?" else 3) for r in given]
    ((cost, audit, _),) = cr.cheapest(codes, {0: cr._Path(0, "", None)}, True).values()
    lines = "\n".join(f"{role}:{t}" for role, t in cr.repaired(audit, [(r[2], r[3]) for r in given]))
    assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, hashlib.sha256(lines.encode()).hexdigest())


def test_damage_by_hand(spark):
    given = [(c, t, "assistant", "One. Two!") for c in range(40) for t in (None, 0, 1)] + [(None, 2, None, None)]
    got = Counter((r["conv_id"], r["turn"], r["gone"], r["role"], r["text"]) for r in cr.damage(conversation(spark, given)).collect())
    want = Counter()
    for c, t, role, body in given:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        hit = zlib.crc32(key.encode()) % 20
        role, body = role or " ", body or " "
        out = {0: (True, "", ""), 1: (False, role, ""), 2: (False, role, body.replace(".", "").replace("!", "")), 4: (False, "user", body)}.get(hit, (False, role, body))
        want[c, t, *out] += 2 if hit == 3 else 1
    assert got == want


def test_repair_of_nothing(spark):
    from pyspark.sql import functions as F

    assert as_turns(spark, [(1, 1, "user", "x")]).limit(0).count() == 0
    gone = cr.repair(cr.faults(conversation(spark, [(1, 1, "user", "x")]).withColumn("gone", F.lit(True))))
    assert [tuple(r) for r in gone.collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# Phrases


def ngrams(docs):
    found, one = Counter(), Counter()
    for lang, body in docs:
        for piece in pm.pieces((body or "").encode()):
            w = piece.split()
            one.update((lang or "und", x) for x in w)
            for n in (2, 3):
                found.update((lang or "und", *w[i : i + n]) for i in range(len(w) - n + 1))
    return found, one


def by_hand(docs, least, percent, top):
    found, one = ngrams(docs)
    f = lambda lang, w: one[lang, w[0]] if len(w) == 1 else found[lang, *w]
    out = {}
    for (lang, *w), a in found.items():
        if a < least:
            continue
        longer = [c for (m, *x), c in found.items() if m == lang and len(x) > len(w) and c >= least and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if any(100 * c >= percent * a for c in longer):
            continue
        score, k = min((10**6 * a * a // (f(lang, w[:k]) * f(lang, w[k:])), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, b" ".join(w), f(lang, w[:k]), f(lang, w[k:])))
    total = Counter()
    for (lang, _), n in one.items():
        total[lang] += n
    return sorted((lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top], 1))


def test_phrases_against_brute_force(spark, docs, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["a", "A", "b", "c", "ß", "É", "é", "x-y", " "]
    given = []
    for k in range(300):
        body = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randrange(25)))
        given.append((rng.choice(["en", "de", None]), rng.choice([body, body, None, ""])))
    given += [("en", "a a a a b a a")] * 5
    table = docs([(k, body, lang, "s") for k, (lang, body) in enumerate(given)])
    for block, share in ((400_000, 1_000_000), (50, 20)):
        monkeypatch.setattr(pm, "BLOCK_WORDS", block)
        monkeypatch.setattr(pm, "PIVOT_ROWS", share)
        got = sorted(tuple(r) for r in pm.collocations(table, least=3, percent=50, top=40).collect())
        assert got == by_hand(given, 3, 50, 40)


def test_fragments_hold_each_ngram_once():
    rng = np.random.default_rng(4)
    for _ in range(50):
        tokens = rng.integers(-1, 5, 60).astype(np.int32)
        ids = rng.permutation(100)[:4] * 1_000_000_007
        rank = dict(zip(range(4), ids.tolist(), strict=True))  # word 4 is too rare
        mined, want = Counter(), Counter()
        for l2, l1, p, r1, r2, n in zip(*pm.rewrite(tokens, np.arange(4), ids), strict=True):
            for gram in ((l1, p), (p, r1), (l2, l1, p), (l1, p, r1), (p, r1, r2)):
                if min(gram) >= 0:
                    mined[tuple(map(int, gram))] += int(n)
        w = [rank.get(int(t), -1) for t in tokens]
        for n in (2, 3):
            want.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1) if min(w[i : i + n]) >= 0)
        assert mined == want


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000
    grams = spark.createDataFrame([(1, 2, None, big)], "w1 long, w2 long, w3 long, a long")
    order = spark.createDataFrame([(1, "en", "x", big + 7), (2, "en", "y", big + 11)], "id long, lang string, word string, f long")
    (row,) = pm.scored(grams, order).collect()
    assert (row["phrase"], row["score"]) == ("x y", 10**6 * big * big // ((big + 7) * (big + 11)))


def test_long_piece_and_empty_table(spark, docs):
    long = "w " * 700_000
    got = pm.collocations(docs([(1, long), (2, None)])).collect()
    assert [(r["phrase"], r["a"], r["n"]) for r in got] == [("w w w", 699_998, 700_000)]
    assert pm.collocations(docs([(1, "x")]).limit(0)).count() == 0
    assert rows(pm.collocations(docs([(1, "x")])).toPandas())[1] == []
