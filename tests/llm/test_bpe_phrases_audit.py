"""Prefix tables, phrase mining and the audit of filters against brute force."""

import base64
import hashlib
import random
import re
import time
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from grainmill.llm import collocations, filter_audit, html_extract, prefix_bpe, token_count, tokens

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, source string, ids string, part string, phrase string, n bigint, a bigint, digest string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """(doc_id, text, lang, source) with columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2, "w") for r in rows], DOCS)


# 11


@pytest.fixture(scope="module")
def encoder():
    return prefix_bpe.PatternEncoder((RANKS, public_tokenizers.PATTERN))


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


def ids(encoder, *texts):
    return [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]


LETTERS = [*map(chr, range(32, 127)), *"  \n\t\r\x1c\x85\xa0éüñßаяЖ中文字日本語ًא😀ề࢏\U0003fc3d<|endoftext|>"]


def odd_text(rng, n):
    return "".join(rng.choice(LETTERS) if rng.random() < 0.4 else rng.choice("aaeehilnorstt'' s  ") for _ in range(rng.randrange(n)))


def test_ids_are_those_of_the_library(encoder, library):
    rng = random.Random(1)
    texts = [odd_text(rng, 80) for _ in range(4000)] + ["", "the", "<|endoftext|>", "it's we'll 'r 're"]
    texts += ["".join(map(chr, (c for c in (rng.randrange(0x40000) for _ in range(30)) if not 0xD800 <= c < 0xE000))) for _ in range(500)]
    assert ids(encoder, *texts) == [library.encode_ordinary(t) for t in texts]
    decoder = prefix_bpe.Decoder(RANKS)
    assert [decoder.decode(x) for x in encoder.encode(texts)] == [t.encode() for t in texts]


def test_small_memory_and_windows_change_nothing(library, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "TOGETHER", 50)
    small = prefix_bpe.PatternEncoder((RANKS, public_tokenizers.PATTERN), memory=2000)
    rng = random.Random(2)
    texts = [odd_text(rng, 300) for _ in range(200)]
    assert ids(small, *texts) == [library.encode_ordinary(t) for t in texts]
    for t in texts:
        for window in (1, 5, 64):
            assert [m for found in small.matches(t, 0, window) for m in found] == [m for found in small.matches(t) for m in found]


def test_long_matches_take_linear_time(encoder, library):
    rng = random.Random(3)
    for t in ("x" * 300_000, " " * 300_000 + "a", "中" * 100_000, "\n" * 100_000, "".join(rng.choice("abcdefghijklmnop") for _ in range(200_000)), "word " * 100_000):
        assert ids(encoder, t) == [library.encode_ordinary(t)]


def test_appends_and_edits(encoder, library):
    rng = random.Random(4)
    pick = lambda n: "".join(rng.choice("abc' reslt\n  12中é.") for _ in range(rng.randrange(n)))
    for _ in range(400):
        live = prefix_bpe.EditableText(encoder, pick(200))
        for _ in range(5):
            a = rng.randrange(len(live.text) + 1)
            b = min(len(live.text), a + rng.randrange(6))
            if rng.random() < 0.4:
                a = b = len(live.text)
            want = live.text[:a] + (new := pick(8)) + live.text[b:]
            live.replace(a, b, new)
            assert live.text == want and live.ids() == library.encode_ordinary(want)


def test_an_edit_makes_few_entries_anew(encoder):
    rng = random.Random(5)
    data = bytes(rng.choice(b"abctheingrs") for _ in range(20_000))
    table = prefix_bpe.Prefixes(encoder.vocabulary, data)
    for _ in range(50):
        at = rng.randrange(len(table.data) - 5)
        assert table.replace(at, at + rng.randrange(5), b"thing"[: rng.randrange(6)]) < 600
    assert table.last == prefix_bpe.Prefixes(encoder.vocabulary, table.data).last
    for n in (1, 7, 500):
        assert b"".join(encoder.vocabulary.tokens[i] for i in table.ids(n)) == table.data[:n]
        assert table.ids(n) == prefix_bpe.Prefixes(encoder.vocabulary, table.data[:n]).ids()


def test_an_edit_near_a_long_text_keeps_the_rest(encoder):
    live = prefix_bpe.EditableText(encoder, "some words and more " * 5000)
    assert live.replace(40_000, 40_003, "xyz") < 20


def test_ranks_below_those_of_their_parts_are_refused(tmp_path):
    path = tmp_path / "odd.tiktoken"
    tokens = [*(bytes([i]) for i in range(256)), b"abc", b"ab"]
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    with pytest.raises(ValueError, match="rank"):
        prefix_bpe.Prefixes(prefix_bpe.Vocabulary(str(path)), b"abc")


def test_digests_of_odd_rows(spark, library):
    rows = [(None, None, "en", "a"), (1, "", "en", "a"), (1, "it's 中", None, "a"), (1, "it's 中", None, "a"), (2, "x" * 5000, "en", None)]
    df = docs(spark, rows)
    got = prefix_bpe.digest(prefix_bpe.decode(prefix_bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(i, len(n := library.encode_ordinary(t or "")), sha(np.array(n, "<u4").tobytes()), sha((t or "").encode())) for i, t, *_ in rows]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert prefix_bpe.decode(prefix_bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


# 12


def slow_phrases(rows, longest=3, least=10, top=2000, covered=50):
    f, total = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(rb"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for key, a in f.items():
        lang, *w = key
        if len(w) < 2 or a < least:
            continue
        over = [f[o] for o in f if len(o) > len(key) and o[0] == lang and f[o] >= least and any(list(o[i : i + len(w)]) == w for i in range(1, len(o) - len(w) + 1))]
        if any(100 * x >= covered * a for x in over):
            continue
        cuts = [(10**6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[key] = (score, a, f[(lang, *w[:k])], f[(lang, *w[k:])])
    ranked = []
    for lang in total:
        best = sorted(((-s, -a, b" ".join(key[1:]), l, r) for key, (s, a, l, r) in out.items() if key[0] == lang))[:top]
        ranked += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(best, 1)]
    return Counter(ranked)


def phrase_rows(n=300):
    rng = random.Random(6)
    rows = [(None, None, "en", "a"), (1, "", None, "a"), (2, "A a, a;a\x0ba a a\ta a\x1fb a", None, "a"), (3, "É é É é É é É é", "fr", "s")]
    for i in range(n):
        w = [rng.choice(["the", "The", "of", "of", "new", "york", "times", "x1", "Ä", f"r{rng.randrange(300)}"]) for _ in range(rng.randrange(60))]
        rows.append((i, "".join(x + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n"]) for x in w), rng.choice(["en", "en", "en", "de", None]), "a"))
    rows += [(1, "one very common line of words that repeats", "en", "a")] * 40
    return rows


@pytest.mark.parametrize("bucket", [1 << 18, 20])
def test_phrases_match_brute_force(spark, monkeypatch, bucket):
    """With small buckets most words are hot, so prefixes are dealt by two and three words."""
    monkeypatch.setattr(collocations, "BUCKET", bucket)
    rows = phrase_rows()
    got = collocations.collocations(docs(spark, rows).repartition(5))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert Counter(map(tuple, got.collect())) == slow_phrases(rows)


def test_phrases_of_two_and_of_four_words(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKET", 20)
    rows = phrase_rows(120)
    for longest in (2, 4):
        got = collocations.collocations(docs(spark, rows), longest=longest, least=6, top=15, covered=70)
        assert Counter(map(tuple, got.collect())) == slow_phrases(rows, longest, 6, 15, 70)


def test_phrases_of_an_empty_table(spark):
    assert collocations.collocations(docs(spark, phrase_rows(3)).limit(0)).count() == 0


def test_a_long_text_is_cut_where_pieces_end():
    rng = random.Random(8)
    data = b"".join(rng.choice([b"word", b" ", b"x", b".", b"\n"]) for _ in range(3000))
    for size in (1, 10, 1000, 10**6):
        found = list(collocations.blocks(data, size))
        assert b"".join(found) == data
        assert collocations.words(b" . ".join(found)).count(b"word") == collocations.words(data).count(b"word")
        assert all(x[-1] in collocations.ENDS for x in found[:-1])


def test_hash_collisions_choose_another_seed(spark, monkeypatch):
    real, seeds = collocations._hash, []

    def short(lang, seed):
        seeds.append(seed)
        return (lambda word: len(word)) if seed == 0 else real(lang, seed)

    rows = docs(spark, [(i, "ab cd ef", "en", "s") for i in range(12)])
    counts = collocations.word_counts(collocations._texts(rows, "text", "lang"))
    assert {r.n for r in counts.collect()} == {12}
    coded = collocations.hashed(counts, 3).collect()
    assert len({r.h for r in coded}) == 3 and {r.h & (1 << 64) - 1 for r in coded} == {real("en", 3)(w) for w in (b"ab", b"cd", b"ef")}


# 13


def slow_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = {}
    for i, text, _, source in rows:
        t = (text or "").encode()
        w, points = WORD.findall(t), len(text or "")
        fails = "".join(
            x
            for x, bad in zip(
                "ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall(rb"[A-Z]", t)) > 2 * points, bool(re.search(rb"[#$%&*|]", t)), i is not None and i > least[text or ""])
            )
            if bad
        )
        parts.setdefault(source or "", []).append((fails, i in good, i in toxic))
    out = []
    for part, found in parts.items():
        mine, total = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(found)
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                total[x] += len(gone)
                mine.append((part, order, step, len(left), len(gone), sum(x in r[0] for r in found) - len(gone), sum(r[0] == x for r in found), sum(r[1] for r in gone), sum(r[2] for r in gone), x))
        out += [(*r[:-1], total[r[-1]]) for r in mine]
    return Counter(out)


def audit_rows():
    rng = random.Random(9)
    rows = [(None, None, "en", None), (None, "", "en", ""), (None, "same text", "en", "a"), (0, "same text", "en", "b"), (0, "same text", "en", "b"), (0, "same text", "en", "a"), (-1, "same text", "en", "a")]
    for i in range(80):
        w = [f"{rng.choice('abC')}{rng.randrange(rng.choice((20, 5000)))}" for _ in range(rng.choice((50, 250, 400)))]
        text = " ".join(w) + rng.choice(["", "", "$", " É|", "\x1c"])
        rows += [(i + 1000 * k, text, "en", rng.choice(["a", "b", None, "Ü"])) for k in range(rng.choice((1, 1, 3)))]
    return rows


def test_audit_matches_brute_force(spark):
    rows = audit_rows()
    labels = [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, 2500, 2)] + [(None, 1, 1), (4, None, None), (6, 0, 1), (6, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(docs(spark, rows).repartition(4), table)
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert Counter(map(tuple, got.collect())) == slow_audit(rows, labels)
    assert filter_audit.audit(docs(spark, rows).limit(0), table).count() == 0
    unlabelled = filter_audit.audit(docs(spark, rows), table.limit(0))
    assert Counter(map(tuple, unlabelled.collect())) == slow_audit(rows, [])


def test_shares_are_means_over_all_orders():
    rng = random.Random(10)
    for _ in range(20):
        counts = {m: rng.randrange(50) for m in range(32)}
        p = filter_audit.RemovalPolynomial(counts)
        for i in range(5):
            total = sum(p.corner(sum(1 << j for j in o[: o.index(i) + 1])) - p.corner(sum(1 << j for j in o[: o.index(i)])) for o in permutations(range(5)))
            assert p.share(i) == Fraction(total, 120)
        for s in range(32):
            assert p.corner(s) == sum(n for m, n in counts.items() if m & s)


# 6: stretches without a boundary


def test_counts_take_linear_time_behind_a_stretch_without_boundary():
    coder = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(11)
    blob = "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(150_000))
    for text in (blob + " " + "some words, and more of them. " * 28_000, "中" * 150_000 + " x" * 50_000, "a\n" * 150_000, blob[:50_000] * 3 + "\n" + blob):
        began = time.process_time()
        want = len(coder.encode(text, add_special_tokens=False).ids)
        library = time.process_time() - began
        began = time.process_time()
        assert token_count.count_tokens(text, coder) == want
        assert time.process_time() - began < 12 * library + 2


def test_counts_spliced_at_any_white_space():
    coder = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(12)
    letters = [*"ab 1.,'\n\t\r  é中\x1c\x85\xa0 ", "<|endoftext|>", " <|endoftext|> "]
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(150)))
        want = len(coder.encode(text, add_special_tokens=False).ids)
        assert [token_count.count_tokens(text, coder, chunk, overlap) for chunk, overlap in ((8, 2), (20, 4), (5, 3))] == [want] * 3


# 4: pages with the article marked by hand

LONG = "<p>" + "A long sentence of the article that goes on. " * 12 + "</p>"
END = "<p>The end.</p>"
COMMENT = "<div class=r><b class=user>{0}</b> <time>today</time><p>{0} liked this very much indeed.</p></div>"
PAGES = [
    (f"<body><div class=content>{LONG}</div><div class=part><p>Short closing paragraph.</p></div></body>", ["goes on.", "Short closing paragraph."], []),
    (f"<body><div class=a>{LONG}</div><div class=b>A heading less aside!</div><div class=c>Label</div></body>", ["goes on.", "heading less"], ["Label"]),
    (f"<article>{LONG}<div class='share-price'>The share price fell.</div><section class='social-history'>Some history</section>{END}</article>", ["price fell.", "Some history", "The end."], []),
    (f"<article>{LONG}<div class='share-buttons'><a href=x>Tweet</a> <a href=y>Post</a></div>{END}</article>", ["goes on.", "The end."], ["Tweet", "Post"]),
    (f"<article>{LONG}<section id=responses>{COMMENT.format('Ann')}{COMMENT.format('Bob')}</section>{END}</article>", ["goes on.", "The end."], ["Ann", "Bob", "today"]),
    (f"<article>{LONG}</article><ol>{''.join(f'<li><span class=author>R{i}</span><span class=date>1 May</span> Reply {i}.</li>' for i in range(3))}</ol>", ["goes on."], ["Reply", "1 May"]),
    (f"<article><p class=byline><span class=author>Ann Lee</span> <time>1 May</time></p>{LONG}{END}</article>", ["Ann Lee", "1 May", "The end."], []),
    ("<main>" + "".join(f"<section><h2>Part {i}</h2><span class=author>A{i}</span><time>{i} May</time>{LONG}</section>" for i in range(3)) + "</main>", ["Part 0", "Part 2", "2 May"], []),
    (f"<body class='no-sidebar'><nav><a href=x>Home</a></nav><article>{LONG}</article><aside>About us.</aside><footer>Imprint.</footer></body>", ["goes on."], ["Home", "About us", "Imprint"]),
    (f"<article>{LONG}<form>Your name: <input></form><div class=advert>Buy now.</div>{END}</article>", ["The end."], ["Your name", "Buy now"]),
    (f"<article>{LONG}<div class=comments><p>First!</p></div>{END}</article>", ["The end."], ["First!"]),
    (f"<table><tr><td class=left><a href=x>One</a><a href=y>Two</a></td><td class=right>{LONG}{END}</td></tr></table>", ["goes on.", "The end."], ["One", "Two"]),
    (f"<h1>Title</h1>{LONG}<ul><li>First point</li><li>Second point</li></ul>{END}", ["Title", "First point", "Second point", "The end."], []),
    (f"<article>{LONG}<blockquote>Said by a reader.</blockquote><figure><figcaption>A caption</figcaption></figure>{END}</article>", ["Said by", "A caption", "The end."], []),
    (f"<div class=cookie-notice>We use cookies.</div><div id=story>{LONG}</div><div class=related><a href=x>More</a></div>", ["goes on."], ["cookies", "More"]),
    (f"<header><h1>Site</h1></header><article><header><h1>Headline</h1></header>{LONG}</article>", ["Headline", "goes on."], ["Site"]),
    (f"<article>{LONG}<p>A &amp; B &lt;c&gt;</p><script>var x = 'No.';</script><style>p {{}}</style></article>", ["A & B <c>"], ["var x", "p {"]),
    (f"<div class=wrap><div class=post-body>{LONG}</div><div class=post-body>{LONG}{END}</div></div>", ["The end."], []),
    (f"<article>{LONG}<article class=x>An answer.</article><article class=x>Another answer.</article>{END}</article>", ["The end."], ["nswer"]),
    ("<article><p>Tiny.</p></article>", ["Tiny."], []),
]


@pytest.mark.parametrize("page, within, without", PAGES)
def test_pages_marked_by_hand(page, within, without):
    text = html_extract.extract(page)
    assert all(x in text for x in within) and not any(x in text for x in without), text[-200:]
    assert text.count("goes on.") == page.count("goes on.")
