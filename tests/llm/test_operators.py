"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import bpe, chat, exact, html, lines, near, packing, quality, urls, warc

LONG = "This very common line is longer than forty characters."
rng = random.Random(7)


def prose(n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) for _ in range(n))


BASE = prose(400)
WORDS = BASE.split()
TEXTS = [None, "", "a", "a b", BASE, BASE, " ".join(WORDS[:-2]), BASE.replace("alpha", "omega", 1), " ".join(w if k % 9 else "new" for k, w in enumerate(WORDS)), "x\n\n y  z \u00a0é\tü", prose(6000), f"{LONG}\nown one", f"  {LONG.upper()} \nown two"]
TEXTS += [f"{LONG}\nline {k}\n{LONG}" for k in range(4)] + ["<|endoftext|> said 's NOT", "\x1c odd\x1c space", "tail \n", "a" * 3000]
KIND = "doc_id bigint, text string, source string, n_words string, length string, _text string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, x, None if k % 5 == 0 else f"s{k % 3}", "clash", "clash", "clash") for k, x in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, BASE, "s1", "", "", "")], KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def brute_repeats(words):
    at = {}
    for k in range(len(words) - 7):
        at.setdefault(tuple(words[k : k + 8]), []).append(k)
    return len({p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 8)})


def test_quality(docs, empty):
    for r in quality.judge(docs).withColumn("same", F.lit(1)).join(docs.select(F.col("doc_id").alias("d"), "text").distinct(), F.col("doc_id").eqNullSafe(F.col("d"))).collect():
        words = (r.text or "").encode().split()
        assert r.n_words == len(words) and r.n_repeat_words == brute_repeats(words)
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words))
    for _ in range(20):
        words = [bytes([rng.randrange(97, 99)]) for _ in range(rng.randrange(60))]
        assert quality.repeated_words(words) == brute_repeats(words)
    assert quality.judge(docs).count() == docs.count() and quality.judge(empty).count() == 0


def test_bad_host_goes(spark):
    rows = [(k, prose(50), f"good{k % 9}") for k in range(180)] + [(1000 + k, "junk" if k % 10 else prose(50), "bad") for k in range(100)]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("kept").collect()}
    assert kept == set(range(180))


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, docs, tmp_path, weak):
    docs.repartition(3).write.parquet(f"{tmp_path}/d")
    digest = (lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 2), 2, "0"))) if weak else exact.sha256
    got = exact.dedup(spark, f"{tmp_path}/d", digest, files_per_batch=1).collect()
    want = {}
    for r in docs.collect():
        want.setdefault(hashlib.sha256((r.text or "").encode()).hexdigest(), []).append(r.doc_id)
    assert len(got) == docs.count()
    for r in got:
        own = want[r.text_sha256]
        assert r.group_size == len(own) and r.keep_id == max(x for x in own if x is not None)
    assert sum(r.kept for r in got) == len(want)


def test_exact_empty(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/d")
    assert exact.dedup(spark, f"{tmp_path}/d").count() == 0


def test_lines(docs, empty):
    got = lines.dedup_lines(docs, batches=3, fanout=2)
    assert got.columns[: len(docs.columns)] == docs.columns
    rows = {(r.doc_id, r.n_lines): r for r in got.collect()}
    last = max(k for k, x in enumerate(TEXTS) if x and LONG in x)
    for k, x in enumerate(TEXTS):
        kept = [v for v in (x or "").split("\n") if k == last or v.strip().lower() != LONG.lower()]
        r = next(r for (d, _), r in rows.items() if d == k)
        assert r.text == "\n".join(kept) and r.n_lines == (x or "").count("\n") + 1 and r.n_dropped == r.n_lines - len(kept)
        assert r.source == (None if k % 5 == 0 else f"s{k % 3}") and (r.n_words, r.length, r._text) == ("clash", "clash", "clash")
    assert lines.dedup_lines(empty).count() == 0


def test_lines_against_brute_force(spark):
    pool = [f"{k} a line that many documents may share, number {k}" for k in range(30)]
    texts = ["\n".join(rng.choice([f" {rng.choice(pool).upper()}\t", rng.choice(pool), "short", "", f"É only in {k} - {rng.random()} {'x' * 30}"]) for _ in range(rng.randrange(12))) for k in range(60)]
    names = "doc_id bigint, text string, name string, gone string, row string, doc string, at string, key string, line string, `a.b` string"
    table = spark.createDataFrame([(k, x, *[f"{c}{k}" for c in "abcdefgh"]) for k, x in enumerate(texts)], names).repartition(3)
    holders = {}
    for k, x in enumerate(texts):
        for line in x.split("\n"):
            key = line.strip(" \t").replace("É", "\0").lower()
            if len(key) >= 40:
                holders.setdefault(key, set()).add(k)
    for batches, fanout, broadcast in ((1, 2, 1), (7, 2, 1 << 20), (6, 3, 0)):
        old, lines.BROADCAST_BYTES = lines.BROADCAST_BYTES, broadcast
        got = lines.dedup_lines(table, batches=batches, fanout=fanout).collect()
        lines.BROADCAST_BYTES = old
        assert len(got) == len(texts)
        for r in got:
            own = texts[r.doc_id].split("\n")
            gone = [len(h := holders.get(x.strip(" \t").replace("É", "\0").lower(), ())) >= 5 and max(h) != r.doc_id for x in own]
            assert r.text == "\n".join(x for x, g in zip(own, gone) if not g) and (r.n_lines, r.n_dropped) == (len(own), sum(gone))
            assert [*r][2:10] == [f"{c}{r.doc_id}" for c in "abcdefgh"]


def test_line_runs_hold_each_key_once(spark):
    """The anti-join with older runs decides where a key goes: into the batch's run, or to the repeats."""
    runs = lines.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(bytes([x]), 10 * k + j) for j, x in enumerate((1, 1, 10 + k, 20 + k // 2))], "key binary, doc_id bigint"))
    found = [r.key for run in runs.runs() for r in run.select("key").collect()]
    assert sorted(found) == sorted({bytes([x]) for k in range(5) for x in (1, 10 + k, 20 + k // 2)})
    assert len(runs.levels) == 3 and [len(x) for x in runs.levels] == [1, 0, 1]
    assert {(r.key, r.last_doc) for r in runs.frequent(2).collect()} == {(b"\x01", 41), (bytes([20]), 13), (bytes([21]), 33)}
    assert [r.key for r in runs.frequent(10).collect()] == [b"\x01"]
    runs.drop()


def brute_near(texts, n, percent):
    sets = []
    for x in texts:
        w = (x or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return {k: (len(sets[k]), root[k]) for k in range(len(texts))}


def test_near(spark, docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.join(docs, 4, 85).collect() if r.doc_id is not None}
    assert got == brute_near(TEXTS, 4, 85)
    assert near.join(empty).count() == 0
    # Copies with edits around the threshold, some of which link only through others.
    texts = []
    for k in range(60):
        words = list(WORDS[:120])
        for _ in range(k % 7):
            words[rng.randrange(120)] = f"edit{rng.randrange(40)}"
        texts.append(" ".join(words))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    for sizes in ({}, {"block": 16, "group": 5}, {"block": 3, "group": 2, "tokens": 900}):  # small blocks: links lie between them
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near.join(table, 4, 85, **sizes).collect()} == brute_near(texts, 4, 85), sizes


def test_token_group_matrix():
    sets = [np.unique(np.array(rng.choices(range(60), k=rng.randrange(1, 40)), np.uint64)) for _ in range(200)]
    sets += [np.delete(x, 0) if len(x) > 1 else x for x in sets[:50]]
    sizes = np.array(list(map(len, sets)))
    for percent, group in ((80, 7), (50, 64), (100, 1)):
        matrix = near.Matrix(sizes, sets, group, percent)
        for x in sets[::9]:
            both = [len(np.intersect1d(x, y)) for y in sets]
            want = [k for k, n in enumerate(both) if n and 100 * n >= percent * (len(x) + len(sets[k]) - n)]
            assert matrix.links(len(x), x).tolist() == want


def test_near_fails_rather_than_losing_tokens(spark, docs):
    """A block of documents that came back in part is an error."""
    parts = near._dealt(docs, 4, None, 8, 1000)
    met = near._met(parts.where("kind = 0 or bucket % 3 > 0")).drop("bucket").cache()
    with pytest.raises(Exception, match="not whole"):
        near._possible(met.where("kind = 1"), met.where("kind = 0"), 85, 2).collect()
    met.unpersist()


def test_packing(docs, empty):
    encode = packing.WordEncoder(packing.vocabulary_path(packing.VOCABULARY))
    rows = packing.pack_documents(docs).collect()
    want = {}
    for k, x in enumerate(TEXTS):
        ids = encode.tokenizer.encode(x or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), 2048):
            want[k, p // 2048] = (p, len(ids[p : p + 2048]), zlib.crc32(np.array(ids[p : p + 2048], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows if r.doc_id is not None} == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


def test_word_encoder_equals_the_tokenizer():
    encode = packing.encoder(packing.vocabulary_path(packing.VOCABULARY))
    chars = "aZzÉéßÿÞ.,;:!?)('s ḋİµªºक़ ½9_-  \x1c\x85\u0301<|>é한中\n\t"
    texts = ["".join(rng.choices(chars, k=rng.randrange(40))) for _ in range(3000)] + ["x<|endoftext|>y", "it's IT'S 'tis", "É" * 3000, ""]
    for text in texts:
        assert encode(text) == np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    small = packing.WordEncoder(packing.vocabulary_path(packing.VOCABULARY), keep=3)
    assert [small(x) for x in texts] == [encode(x) for x in texts]


def test_plan_places_everything():
    for _ in range(50):
        counts = {rng.randrange(1, 101): rng.randrange(1, 9) for _ in range(rng.randrange(1, 40))}
        runs, bins = packing.plan(counts, 100)
        fill, seen = {}, {}
        ends = {}
        for length, rank, *_ in sorted(runs):
            ends.setdefault(length, []).append(rank)
        for length, rank, first, per, offset in runs:
            later = [x for x in ends[length] if x > rank]
            n = (min(later) if later else counts[length]) - rank
            seen[length] = seen.get(length, 0) + n
            for k in range(n):
                fill.setdefault(first + k // per, []).append((offset + k % per * length, length))
        assert seen == counts and len(fill) == bins
        for own in fill.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 100 and sum(3 * x > 100 for _, x in own) <= 2


def test_bpe(docs, empty):
    path = bpe.vocabulary_path(bpe.VOCABULARY)
    tokenizer = bpe._tokenizer(path)
    got = {r.doc_id: r for r in bpe.digests(docs, block_words=300).collect()}
    for k, x in enumerate(TEXTS):
        ids = tokenizer.encode(x or "", add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(empty).count() == 0 and bpe.encode(docs).count() == docs.count()


def test_bpe_decodes_through_the_table(monkeypatch):
    import pyarrow as pa

    tokenizer = bpe._tokenizer(bpe.vocabulary_path(bpe.VOCABULARY))
    rows = bpe.piece_table(bpe.vocabulary_path(bpe.VOCABULARY))
    ids = [np.array(tokenizer.encode(x or "", add_special_tokens=False).ids, "<u4") for x in TEXTS]
    want = [tokenizer.decode(x.tolist(), skip_special_tokens=False) for x in ids]
    assert bpe.decode(ids, pa.array(rows, pa.binary())) == want
    monkeypatch.setattr(bpe, "IDS_AT_ONCE", 7)
    assert bpe.decode(ids, pa.array(rows, pa.binary())) == want
    damaged = list(rows)
    damaged[int(ids[4][0])] = b"?"
    assert bpe.decode([ids[4]], pa.array(damaged, pa.binary())) != [want[4]]
    with pytest.raises(IndexError):
        bpe.decode([np.array([len(rows)], "<u4")], pa.array(rows, pa.binary()))


def test_bpe_splits_where_the_tokenizer_does():
    """Encoding word by word gives the ids of the whole text, whatever the text."""
    tokenizer = bpe._tokenizer(bpe.vocabulary_path(bpe.VOCABULARY))
    chars = "aZéß.,!'s \u00a0\u2003\u3000\x1c\x85\u200b\u0301\x00\r\n\t  \n9½中|<>"
    for _ in range(3000):
        text = "".join(rng.choices(chars, k=rng.randrange(30)))
        words = bpe.split_words(text)
        assert "".join(words) == text
        assert [i for e in tokenizer.encode_batch(words, add_special_tokens=False) for i in e.ids] == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_warc(spark):
    rows = [(1, "http://a/\r\nx", "same"), (2, "b", "same"), (3, None, None), (4, "d", ""), (5, "e", "é" * 50_000), (5, "e", "é" * 50_000), (None, "n", "same"), (7, "g", "alone")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha", F.lit("clash"))
    at = warc.write(pages, frame_bytes=64, bundle_bytes=256)
    got = warc.read(at).collect()
    assert len(got) == len(rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert kinds == {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "revisit", 2), (7, "response", None)}
    for r in got:
        body = next(h or "" for p, _, h in rows if p == r.page_id).encode()
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.payload == (None if r.record_type == "revisit" else body)
    one = warc.fetch(at, spark.createDataFrame([(7,)], "page_id bigint")).collect()
    assert [bytes(r.payload) for r in one] == [b"alone"]
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    # Records are found by the index alone: a row less is a record less, a wrong one an error.
    assert warc.read(at.where("page_id is null or page_id != 7")).count() == len(rows) - 1
    for wrong in ("offset + 1 as offset", "frame_start + 1 as frame_start", "length - 1 as length", "page_id + 1 as page_id"):
        with pytest.raises(Exception):
            warc.read(at.where("page_id = 7").selectExpr(*[wrong if wrong.endswith(f" as {c}") else c for c in at.columns])).collect()
    kept = warc.read(warc.write(pages, min_bytes=5)).where("record_type = 'revisit'").collect()  # "same" is smaller, 5's copies are responses
    assert kept == [] and warc.read(warc.write(pages, min_bytes=4)).where("record_type = 'revisit'").count() == 2
    old, warc.BROADCAST_BYTES = warc.BROADCAST_BYTES, 0
    assert sorted(warc.read(warc.write(pages)).collect(), key=repr) == sorted(got, key=repr)
    warc.BROADCAST_BYTES = old


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home {k}</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Head {k}</h1></header><p>One &amp; <b>two</b> {k}<br><p>Three&nbsp;four<script>"</p>"</script>
<div class="comments"><p>first!</p></div></article><aside>Side</aside><form>Search</form><footer>&copy; {k}</footer></body></html>"""


def test_html(spark):
    rows = [(k, f"http://h/{k}", PAGE.format(k=k)) for k in range(6)] + [(10, None, None), (11, "x", ""), (12, "http://o/", "<p>Only text"), (13, "http://h/z", PAGE.format(k=5)), (13, "http://h/z", PAGE.format(k=5)), (14, "http://h/cut", PAGE.format(k=9)[:-30])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html.extract_pages(pages).collect()}
    for k in range(6):
        assert got[k] == f"Head {k}\n\nOne & two {k}\n\nThree four"
    assert got[10] == got[11] == "" and got[12] == "Only text" and got[13] == got[5] and got[14] == "Head 9\n\nOne & two 9\n\nThree four"
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_html_without_names(spark):
    page = "<html><body><div class=menu><a href=/>Home</a></div><div id=x{k}><p>" + "words and more words. " * 9 + "{k}</p></div><div class=footer>end</div></body></html>"
    rows = [(k, f"http://n/{k}", page.format(k=k)) for k in range(4)]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[k] == "words and more words. " * 9 + str(k) for k in got)


@pytest.mark.parametrize("n", [1, 2, 3, 30])
def test_html_lists_of_links(spark, n):
    # A page's own sources stay, however many pages its host has; a menu that is the same on all pages goes where a template shows it.
    page = "<html><body><article><p>{own}</p><ul class=x><li><a href=/a>Front</a></li><li><a href=/b>Sport</a></li></ul><ol><li><a href=/{k}>Source {k} of the story</a></li><li><a href=/>Paper {k}</a></li></ol></article></body></html>"
    rows = [(k, f"http://l/{k}", page.format(k=k, own=f"Story {k} has words of its own. " * 4)) for k in range(n)]
    got = {r.page_id: r.text.split("\n\n") for r in html.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    menu = [] if n >= html.MIN_PAGES else ["Front", "Sport"]
    assert got == {k: [(f"Story {k} has words of its own. " * 4).strip(), *menu, f"Source {k} of the story", f"Paper {k}"] for k in range(n)}


def test_html_template_classes(spark):
    # No name tells the long legal text or the label from the article: only their classes do.
    page = "<html><body><div class=a><p>{own}</p><div class=b>Label of the house</div></div><div class=c><p>{legal}</p></div></body></html>"
    legal = "The very same long legal words stand here on each of the pages. " * 20
    rows = [(k, f"http://t/{k}", page.format(own=f"Story {k} has words of its own. " * 4, legal=legal)) for k in range(5)]
    # Three copies among other pages: text common to some pages is no template.
    rows += [(10 + k, "http://t/copy", page.format(own="A copied story. " * 6, legal=legal)) for k in range(3)]
    rows += [(None, "http://t/null", page.format(own=f"Null {k} has words of its own. " * 4, legal=legal)) for k in range(2)]
    # All pages alike: nothing is taken for the template's.
    rows += [(20 + k, "http://same/", "<html><body><div class=a><p>One story told again.</p></div></body></html>") for k in range(3)]
    got = [(r.page_id, r.text) for r in html.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()]
    want = [(k, (f"Story {k} has words of its own. " * 4).strip()) for k in range(5)] + [(10 + k, ("A copied story. " * 6).strip()) for k in range(3)]
    want += [(None, (f"Null {k} has words of its own. " * 4).strip()) for k in range(2)] + [(20 + k, "One story told again.") for k in range(3)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_chat(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "assistant", r"\<|done|></s>"), (1, 3, None, None), (2, 0, "assistant", ""), (None, 0, "user", "x" * 9999), (None, 0, "user", "x" * 9999)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.chat_digests(turns).collect()}
    for c, order in {1: [1, 0, 2, 3], 2: [4], None: [5, 6]}.items():
        own = sorted((rows[k] for k in order), key=lambda r: r[1])
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own).encode()).hexdigest()
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    text = chat.format_conversations(turns).where("conv_id = 1").first().formatted
    assert text.count(chat.OPEN) == 3 and text.count(chat.NEXT) == 1
    assert chat.chat_digests(turns.limit(0)).count() == 0


def test_urls(spark):
    cases = {
        "http://www.Shop.com/en/x": ("com/en/", "block"), "https://a.example.com/en/71?q#f": ("example.com/en/7", "allow"), "http://x.net/de/": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "http://a.org/es/1": ("org/es/", "block"), "http://notcom/en/": (None, None), "a://b?x://c/d": (None, None), "": (None, None), None: (None, None),
    }
    table = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge(table).collect()}
    for k, (rule, verdict) in enumerate(cases.values()):
        assert got[k].rule == rule and got[k].verdict in ((verdict,) if verdict else ("allow", "block"))
    assert (got[0].host, got[0].path, got[6].host, got[6].path, got[8].host) == ("www.shop.com", "/en/x", "b", "", "")
    assert urls.judge(table.limit(0)).count() == 0


def test_url_model_on_held_out_names(spark):
    bad, good = ["blog.casino-bonus.example.net", "m.spam-farm.example.org", "cheap-viagra.example.com"], ["m.theology.example.net", "blog.railway.example.org", "kitchen.example.com"]
    rows = [(k, f"http://{h}/fr/{k}") for k, h in enumerate(bad + good)]
    got = [r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), rules=()).orderBy("page_id").collect()]
    assert got == ["block"] * 3 + ["allow"] * 3


def test_odd_markup_inside_an_article():
    prose = "<p>" + "Real prose of the article goes on here for a while. " * 4 + "</p>"
    for inner, want in (
        ('<div class="article-header"><p>Lead text</p></div>', "Lead text"),
        ('<p class="story-share-price">Shares rose.</p>', "Shares rose."),
        ('<section class="side-effects"><p>Nausea.</p></section>', "Nausea."),
        ("<button>Click<p>More text.</p>", "Click\n\nMore text."),
        ("<button>Click</button><p>More text.</p><button>On", "More text.\n\nOn"),
        ("<svg><svg></svg>LEAK</svg><p>End.</p>", "End."),
        ('<div class="share-buttons">Share</div><div class="side-bar">S</div><p class="ad">Buy</p><aside>A</aside><p>End.</p>', "End."),
    ):
        got = html.extract(f"<body><article>{prose}{inner}</article></body>", None)
        assert got.split("\n\n", 1)[1] == want, inner


def test_columns_of_any_name_are_kept(spark):
    names = ["salt", "n", "prior", "rank", "_salt", "_n", "host", "_source", "a.b"]
    rows = [(k, 0, 1 + k % 5, *[f"{c}{k}" for c in names]) for k in range(40)]
    pieces = spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint, " + ", ".join(f"`{c}` string" for c in names)).cache()
    for salt_rows in (500_000, 1):
        got = packing.pack(pieces, 8, salts=2, salt_rows=salt_rows).collect()
        assert {tuple(r)[:12] for r in got} == set(rows) and len({(r.sequence_id, r.offset) for r in got}) == 40
        ends = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
        assert max(ends.values()) <= 8
    docs = pieces.selectExpr("doc_id", "concat('word ', doc_id) AS text", "if(doc_id % 3 = 0, null, 's') AS source", *[f"`{c}`" for c in names])
    judged = quality.judge(docs).collect()
    assert {(r.doc_id, *[r[c] for c in names]) for r in judged} == {(r[0], *r[3:]) for r in rows}
