"""The training-data operators against brute force, exact round trips and held-out accuracy, with edge cases."""

import base64
import hashlib
import io
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threadlake.llm import decontaminate, language, minhash, pii, quality, queries, sentencepieces, sstable, stages, url_filter, warc, winnow
from threadlake.llm import common
from threadlake.llm.common import bucket_of

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "a", "  a  b ", "line\n\ntwo\n", "It's  İ Σ. É! <|endoftext|> ▁x ﬁ ½\t\x00z　 é", "same text here", "same text here", "x" * 5000, "no-space" * 700, "日本語テキスト" * 50, " \n \t"]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, "en", None, 5, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", None, "s", None, None), (6, TEXTS[6], "en", None, 5, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words3(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def classes(rows, n, percent):
    sets = {i: words3(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            m = len(sets[a] & sets[b])
            if m and 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_quality_held_out(spark, docs):
    got = queries.op1_quality(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert set(held.doc_id) == {i for i in got.doc_id if zlib.crc32(str(i).encode()) % 3 == 1}
    assert (held.predicted == held.quality).mean() >= 0.9
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_quality_dot_products_equal_features():
    w = np.random.default_rng(1).normal(size=2**quality.BITS + 1).astype(np.float32)
    want = [w[i] @ x + w[-1] for i, x in map(quality.features, TEXTS)]
    assert np.allclose(quality.dots(TEXTS, w, quality.Tokens()), want, atol=1e-4)


def test_quality_updates_equal_a_plain_loop():
    """The same passes, one weight at a time, as the published algorithm states them."""
    import math

    pick = np.random.default_rng(3)
    rows = [(np.unique(pick.integers(0, 16, 5)), None, int(pick.integers(0, 2))) for _ in range(12)]
    rows = [(at, pick.random(len(at)).astype(np.float32), y) for at, _, y in rows]
    z, n, order = [0.0] * 17, [0.0] * 17, np.random.default_rng(7)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(3):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            pairs = [*zip(map(int, at), map(float, x), strict=True), (16, 1.0)]
            w = [weight(i) for i, _ in pairs]
            p = 1 / (1 + math.exp(-sum(a * v for a, (_, v) in zip(w, pairs, strict=True))))
            for a, (i, v) in zip(w, pairs, strict=True):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * a
                n[i] += g * g
    assert np.allclose(quality.ftrl(rows, bits=4, epochs=3), [weight(i) for i in range(17)], atol=1e-6)


def test_quality_scores_do_not_depend_on_the_table(monkeypatch):
    w = np.random.default_rng(1).normal(size=2**quality.BITS + 1).astype(np.float32)
    want = quality.dots(TEXTS, w, quality.Tokens())
    monkeypatch.setattr(quality, "TABLE_CHARS", 3)
    table = quality.Tokens()
    assert np.allclose([quality.dots([t], w, table)[0] for t in TEXTS], want)


def test_quality_edges(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int")
    scored = quality.score(edge, quality.train(edge, none)).collect()
    assert len(scored) == edge.count() and {r["score"] for r in scored} == {0.5}
    assert quality.score(edge.limit(0), np.zeros(2**quality.BITS + 1, np.float32)).count() == 0
    assert quality.accepted(edge, np.zeros(2**quality.BITS + 1, np.float32)).columns == edge.columns


def test_tokens_round_trip(spark, edge, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.WORD_BPE)
    for table in (edge, docs):
        rows = sorted(((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        got = sorted(sstable.round_trip(table, queries.WORD_BPE).collect(), key=lambda r: r["start"])
        start = 0
        for (i, t), r in zip(rows, got, strict=True):
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
            start += len(ids)
    assert sstable.round_trip(edge.limit(0), queries.WORD_BPE).count() == 0


def test_shard_lookup_and_filter(tmp_path):
    w = sstable.Writer(f"{tmp_path}/a.sst", 2)
    keys = [None, -5, 0, 7, 7, 300, 2**40]
    for i, k in enumerate(keys):
        w.add(sstable.key_of(k), struct.pack("<3I", i, 40_000, 1) * 9000)
    assert w.close() == (7, 7 * 27_000)
    r = sstable.Reader(f"{tmp_path}/a.sst")
    assert len(r.places) > 1
    for k in set(keys):
        assert [int(x[0]) for x in r.get(k)] == [i for i, y in enumerate(keys) if y == k]
    assert r.get(8) == [] and sum(r.may_hold(sstable.key_of(k)) for k in range(1000, 2000)) < 100
    with pytest.raises(ValueError, match="ascend"):
        w2 = sstable.Writer(f"{tmp_path}/b.sst", 2)
        w2.add(b"b", b"")
        w2.add(b"a", b"")


def test_shard_lookup_on_spark(spark, docs):
    from threadlake.session import shared_dir

    from threadlake.llm.common import written

    manifest = written(spark, sstable.write_shards(docs, queries.WORD_BPE, shared_dir(spark, "lookup")), "m")
    wanted = spark.createDataFrame([(3,), (77,), (10**9,), (None,)], "doc_id long")
    got = {r["doc_id"]: r["ids"] for r in sstable.lookup(manifest, wanted).collect()}
    assert set(got) == {3, 77} and all(v[-1] == 1 for v in got.values())


def test_language_held_out(spark):
    got = queries.op3_language(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").toPandas()[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.95 and got.score.between(0, 1).all()


def test_language_edges(spark, edge, docs):
    prototypes = language.train(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(edge, prototypes).collect()}
    assert got[0] == got[1] == got[11] == "und" and got[6] in prototypes
    assert {r["lang_pred"] for r in language.predict(edge, {}).collect()} == {"und"}
    assert language.train(edge.limit(0)) == {} and language.predict(edge.limit(0), prototypes).count() == 0


def test_bundle_is_the_sum_of_bound_trigrams():
    v = language.bundle(*language.trigrams(["ab a", "ba"]), 2)[1]
    at = {c: language.vector(ord(c)).astype(int) for c in " ab"}
    tri = lambda x: np.roll(at[x[0]], 2) * np.roll(at[x[1]], 1) * at[x[2]]
    assert (v == tri(" ba") + tri("ba ")).all()


def test_bundles_of_many_letters_are_sparse_and_equal(monkeypatch):
    pick = random.Random(4)
    texts = ["".join(chr(0x4E00 + pick.randrange(20_000)) for _ in range(300)) for _ in range(80)] + ["plain words here"]
    made = language.trigrams(texts)
    want = language.bundle(*made, len(texts))
    assert len(made[2]) > 2 * language.STEP
    monkeypatch.setattr(language, "SPARSE", 10**9)  # products alone
    assert (language.bundle(*made, len(texts)) == want).all()


def winnow_brute(text):
    """Plainly: the residues of every 16 characters, and of every 16 of those the smallest, rightmost of equals."""
    text, k, w = text or "", winnow.K, winnow.W
    if not text:
        return []
    g = [zlib.crc32(text[i : i + k].encode("utf-32-be")) for i in range(max(1, len(text) - k + 1))]
    out = []
    for s in range(max(1, len(g) - w + 1)):
        window = g[s : s + w]
        p = s + max(i for i, h in enumerate(window) if h == min(window))
        if (p, g[p]) not in out[-1:]:
            out.append((p, g[p]))
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij ", "".join(map(chr, range(0x4E00, 0x4E80))), "xy😀"])
def test_shared_passages_share_fingerprints(spark, alphabet):
    """Of K + W - 1 characters in a row a fingerprint is shared, wherever they stand and with or without white space."""
    pick, n = random.Random(alphabet), winnow.K + winnow.W - 1
    some = lambda m: "".join(pick.choice(alphabet) for _ in range(m))
    rows = []
    for i in range(40):
        passage = some(n)
        rows += [(2 * i, some(i) + passage + some(7 * i)), (2 * i + 1, some(3 * i + 1) + passage + some(5))]
    got = {r["doc_id"]: {p.split(":")[1] for p in r["fingerprint"].split(",")} for r in winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] & got[2 * i + 1] for i in range(40))


def test_pieces_of_long_texts_join(spark, monkeypatch):
    text = "".join(random.Random(9).choice("abc ") for _ in range(700))
    rows = spark.createDataFrame([(i, text[:i]) for i in range(0, 700, 23)], "doc_id long, text string")
    monkeypatch.setattr(winnow, "PIECE", 50)
    for r in winnow.fingerprints(rows).collect():
        assert r["fingerprint"] == ",".join(f"{p:x}:{h:x}" for p, h in winnow_brute(text[: r["doc_id"]]))


def test_winnowing_equals_brute_force(spark, edge, docs):
    for table in (edge, docs.limit(60)):
        for r in winnow.fingerprints(table).join(table.select("doc_id", "text").distinct(), "doc_id").collect():
            assert r["fingerprint"] == ",".join(f"{p:x}:{h:x}" for p, h in winnow_brute(r["text"]))


def test_edited_texts_and_neighbours(spark, docs, edge):
    got = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, SF).collect()}
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    prints = {i: {h for _, h in winnow_brute(t)} for i, t in rows}
    for k, (i, t) in enumerate(rows):
        j, nxt = rows[(k + 1) % len(rows)]
        m = len(t) // 3
        made = t[: len(t) - m] + nxt[:m]
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(made.encode()).hexdigest() and r["n_chars"] == len(t)
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert r["near_edited"] == pytest.approx(like(prints[i], {h for _, h in winnow_brute(made)}))
        assert r["near_next"] == pytest.approx(like(prints[i], prints[j]))
    assert winnow.compare(edge).count() == edge.count()
    assert winnow.compare(edge.limit(0)).count() == 0
    assert winnow.compare(edge.where("doc_id = 6").limit(1)).first()["near_next"] == 1.0


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 200_000), (2, "u", "x" * 200_000), (3, None, None), (4, "a\r\nb", ""), (5, "u", "é\r\n\r\n"), (None, "u", "x" * 200_000), (5, "u", "é\r\n\r\n")], "page_id long, url string, html string")
    got = warc.round_trip(pages, payload=True, files=3).collect()
    seen = sorted(((r["page_id"] is not None, r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=str)
    assert seen == sorted([(True, 1, "revisit", 2, 200_000), (True, 2, "response", None, 200_000), (True, 3, "revisit", 4, 0), (True, 4, "response", None, 0), (True, 5, "response", None, 6), (True, 5, "response", None, 6), (False, 0, "revisit", 2, 200_000)], key=str)
    assert {r["payload_digest"] for r in got if r["page_id"] == 5} == {base64.b32encode(hashlib.sha1("é\r\n\r\n".encode()).digest()).decode()}
    assert warc.round_trip(pages.limit(0)).count() == 0
    kinds = {(r["page_id"], r["record_type"]) for r in warc.round_trip(pages.where("page_id < 5"), min_bytes=1).collect()}
    assert {(3, "response"), (4, "response"), (1, "revisit")} <= kinds


def test_warc_reader_refuses_broken_archives():
    good = warc.member(warc.record(1, "u", b"hello", 5, warc.b32(hashlib.sha1(b"hello").digest()), None))
    assert [warc.parse(x)["payload"] for x in warc.read_members(io.BytesIO(good + good))] == [b"hello", b"hello"]
    with pytest.raises(warc.WarcError, match="cut off"):
        list(warc.read_members(io.BytesIO(good[:-9])))
    with pytest.raises(warc.WarcError, match="digest"):
        warc.parse(warc.record(1, "u", b"hello", 5, warc.b32(hashlib.sha1(b"other").digest()), None))
    with pytest.raises(warc.WarcError, match="no warc-block-digest"):
        warc.parse(re.sub(rb"WARC-Block-Digest[^\r]*\r\n", b"", zlib.decompress(good, 31)))


_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain_brute(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in _EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_plain_spans_equal_the_patterns():
    pick = random.Random(5)
    for _ in range(3000):
        text = "".join(pick.choice("ab1.@-+ 05é(9)%") for _ in range(pick.randrange(60)))
        assert pii.spans(text)[0] == plain_brute(text), text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe [at] mail8 [dot] example [dot] com now", "email", "john.doe [at] mail8 [dot] example [dot] com"),
        ("write to john at example dot com, please", "email", "john at example dot com"),
        ("kontakt: info at firma dot de heute", "email", "info at firma dot de"),
        ("jоhn.42@mail8.example.com here", "email", "jоhn.42@mail8.example.com"),
        ("jo​hn@example.com", "email", "jo​hn@example.com"),
        ("call plus four nine three zero one two three four five six seven ok", "phone", "plus four nine three zero one two three four five six seven"),
        ("é ＋４９ ３０ １２３４５６７８.", "phone", "＋４９ ３０ １２３４５６７８"),
    ],
)
def test_disguised_spans_map_back(text, kind, found):
    base, every = pii.spans(text)
    assert (kind, found) in [(k, text[s:e]) for k, s, e in every]
    assert set(base) <= set(every)


def test_clean_texts_have_no_spans():
    for text in ("look at the dot on the page", "we met at noon. Then one two and home", "(at) last", "seven eight, nine", ""):
        assert pii.spans(text) == ([], []), text


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("ask john at example [dot] com now", "john at example [dot] com"),
        ("john at example.com", "john at example.com"),
        ("my mail is john at example.com for now", "john at example.com"),
        ("john.doe at mail.example dot com or so", "john.doe at mail.example dot com"),
        ("anna at posta dot it", "anna at posta dot it"),
        ("e-mail anna at firma dot be or call", "anna at firma dot be"),
        ("ask max7 at firma dot at about it", "max7 at firma dot at"),
        ("ask bob at mail dot agency dot us about it", "bob at mail dot agency dot us"),
        ("ask john dot smith at example dot com today", "john dot smith at example dot com"),
        ("ask john [dot] smith (at) example dot com today", "john [dot] smith (at) example dot com"),
        ("ask john dot smith@example.com today", "john dot smith@example.com"),
        ("reach me at john dot smith at example dot com", "john dot smith at example dot com"),
        ("ask john @ example.com today", "john @ example.com"),
        ("write to anna at museum dot berlin please", "anna at museum dot berlin"),
        ("ask john at example dot com.", "john at example dot com"),
    ],
)
def test_mixed_disguises_of_addresses(text, found):
    assert [(k, text[s:e]) for k, s, e in pii.spans(text)[1] if text[s:e] == found] == [("email", found)]
    assert pii.redacted(text, pii.spans(text)[1]) == text.replace(found, "[EMAIL]")


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("host 192 dot 168 dot 1 dot 1 is up", "ip", "192 dot 168 dot 1 dot 1"),
        ("host one nine two [dot] one six eight [dot] one [dot] one is up", "ip", "one nine two [dot] one six eight [dot] one [dot] one"),
        ("host ten, one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("host one.two.three.four is up", "ip", "one.two.three.four"),
        ("host 10.one.2.three is up", "ip", "10.one.2.three"),
        ("call +49 30 five 5 one 2 three 4 5 six today", "phone", "+49 30 five 5 one 2 three 4 5 six"),
        ("call plus 49 30 five 5 one 2 three 4 5 six today", "phone", "plus 49 30 five 5 one 2 three 4 5 six"),
        ("call +four nine  30 1234567 today", "phone", "+four nine  30 1234567"),
        ("card 4111 1111 1111 one one 1 1 used", "card", "4111 1111 1111 one one 1 1"),
        ("card four.one.one.one.one.one.one.one.one.one.one.one.one.one.one.one used", "card", "four.one.one.one.one.one.one.one.one.one.one.one.one.one.one.one"),
        ("card ４１１１ １１１１ １１１１ １１１１ one of", "card", "４１１１ １１１１ １１１１ １１１１"),
    ],
)
def test_few_spelled_digits_and_dots(text, kind, found):
    assert (kind, found) in [(k, text[s:e]) for k, s, e in pii.spans(text)[1]]


def test_few_spelled_digits_in_prose():
    for text in ("one of 2 dots, version 3 dot 1", "in 2019 one two or 3. four", "two dot three dot four", "plus one or two, zero"):
        assert pii.spans(text) == ([], []), text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("ruf plus vier neun drei null eins zwei drei vier fünf sechs an", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs"),
        ("appelez plus trois trois un deux trois quatre cinq six sept huit ici", "phone", "plus trois trois un deux trois quatre cinq six sept huit"),
        ("llama más tres cuatro nueve uno dos tres cuatro cinco seis siete ya", "phone", "más tres cuatro nueve uno dos tres cuatro cinco seis siete"),
        ("frag jane at firma punkt de heute", "email", "jane at firma punkt de"),
        ("pregunta juan arroba ejemplo punto com hoy", "email", "juan arroba ejemplo punto com"),
        ("demande jean arobase exemple point fr demain", "email", "jean arobase exemple point fr"),
        ("host 192 punkt 168 punkt 1 punkt 1 geht", "ip", "192 punkt 168 punkt 1 punkt 1"),
    ],
)
def test_disguises_in_other_languages(text, kind, found):
    assert (kind, found) in [(k, text[s:e]) for k, s, e in pii.spans(text)[1]]


def test_clean_texts_in_other_languages():
    for text in ("Es waren zwei, drei oder vier Leute am Punkt de Haan", "un deux trois, nous irons au bois", "à ce point de vue, un point c'est tout", "uno dos tres cuatro y punto final", "look at this point in time", "prices at freezing point in winter", "null und eins, acht Neuntel"):
        assert pii.spans(text) == ([], []), text


@pytest.mark.parametrize("text", ["<" + " " * 10**6 + "x", "1" * 10**6, "plus" + " " * 10**6, "1." * 500_000, "one " * 250_000, "a@" * 300_000, "+1 " * 300_000, "( at " * 200_000, "0" * 10**6 + ".1.1.1"])
def test_time_grows_with_the_length(text):
    import time

    began = time.process_time()
    pii.spans(text)
    assert time.process_time() - began < 20


def test_prose_with_at_and_dots_has_no_addresses():
    for text in ("More at example.com today", "visit us at www.example.com", "Contact us at example.com", "we met at noon.Then it rained", "opened at 9.30 daily", "look at the dot it made", "He stared at a dot. It moved", "tickets are available at docs.example.org/x", "thanks @user.name!"):
        assert pii.spans(text) == ([], []), text


def test_pii_query_and_redaction(spark, edge, docs):
    for r in queries.op6_pii(spark, SF).join(docs, "doc_id").collect():
        base = plain_brute(r["text"])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
    assert pii.find(edge).count() == edge.count() and pii.find(edge.limit(0)).count() == 0
    t = spark.createDataFrame([(1, "to a@b.co and +49 30 1234567", 3), (2, None, 4)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redact(t, "text", "n_chars").orderBy("doc_id").collect()] == [(1, "to [EMAIL] and [PHONE]", 22), (2, None, 4)]


def test_sentencepiece_equals_the_library(spark, edge, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
    for table in (edge, docs):
        for r in sentencepieces.encode_decode(table.select("doc_id", "text").distinct().withColumn("k", F.struct("doc_id", "text")), queries.PIECE_BPE, id_col="k").collect():
            ids = sp.encode(r["k"]["text"] or "")
            assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), sp.decode(ids))
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepieces.encode_decode(edge.limit(0), queries.PIECE_BPE).count() == 0


def test_sentencepiece_table_may_be_emptied(monkeypatch):
    monkeypatch.setattr(sentencepieces, "TABLE_CHARS", 2)
    c = sentencepieces.ChunkCodec(queries.PIECE_BPE)
    assert [[e[1] for e in x] for x in c.encode(["one two three", "four"])] == [[e[1] for e in x] for x in c.encode(["one two three", "four"])]


def spread(seed, groups=4, copies=14):
    """Groups of copies with few to many edits, half of them chains."""
    pick = random.Random(seed)
    words, rows = [f"w{i}" for i in range(2000)], []
    for g in range(groups):
        base = [pick.choice(words) for _ in range(pick.choice([30, 80, 160]))]
        now = base
        for _ in range(copies):
            now = list(now if g % 2 else base)
            for _ in range(pick.choice([0, 1, 1, 2, 3, 6])):
                now[pick.randrange(len(now))] = pick.choice(words)
            rows.append((len(rows), " ".join(now)))
    return [*rows, (len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "A b"), (len(rows) + 3, "a  B"), (len(rows) + 4, rows[0][1])]


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 85, 2_000_000), (5, 80, 1500)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(common, "HEAVY", 3)  # so that buckets, centres and copies are dealt out
    rows = spread(n)
    want = classes(rows, n, percent)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_pairs_of_a_bucket_with_one_shared_band_are_compared():
    import pandas as pd

    grams, bands = np.arange(100, dtype=np.int64), np.arange(3 * minhash.BANDS, dtype=np.int64).reshape(3, -1)
    bands[:, 7] = -1  # three members of one bucket that share nothing else
    pdf = pd.DataFrame({"key": -1, "band": 7, "id": [1, 2, 3], "comp": [1, 2, 3], "block": 0, "i": 0, "j": 0, "bands": list(bands), "grams": [grams + 1000, grams, grams + 5]})
    found = minhash.compare_block(85)(pdf)
    assert found.values.tolist() == [[2, 3]]
    pdf["band"] = 6  # not the first band that they share
    assert minhash.compare_block(85)(pdf).empty


def test_near_duplicates_edges(spark, edge):
    got = minhash.near_duplicates(edge, 3, 85).collect()
    assert len(got) == edge.count()
    by = {r["doc_id"]: r for r in got}
    assert by[7]["component_id"] == 6 and by[0]["component_id"] == 0 and by[None]["kept"] and by[None]["component_id"] is None
    assert minhash.near_duplicates(edge.limit(0), 3, 85).count() == 0
    kept = minhash.deduplicated(edge, 3, 85)
    assert kept.columns == edge.columns and kept.where("doc_id = 7").count() == 0 and kept.where("doc_id is null").count() == 1
    assert kept.where("doc_id = 6").count() == 1  # of the two equal rows
    clash = edge.withColumns({"id": F.lit(7), "kept": F.lit(1), "__gone": F.lit(2)})
    assert minhash.deduplicated(clash, 3, 85).columns == clash.columns


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated_brute(texts, items):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    windows = {}
    for i, t in items:
        w = _WORD.findall(lower(t))
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    out = {}
    for i, t in texts:
        w = _WORD.findall(lower(t))
        hit, seen = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    seen |= windows[k]
                    hit[p : p + n] = [1] * n
        out[i] = (len(w), sum(hit), sorted(map(str, seen)))
    return out


def split(text):
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def matches_brute(text, items):
    """Every verbatim match of a window or more that cannot be made longer on either side."""
    w, out = split(text), set()
    for item, t in items:
        v = split(t)
        for i in range(len(v)):
            for p in range(len(w)):
                if i and p and v[i - 1] == w[p - 1]:
                    continue
                n = 0
                while i + n < len(v) and p + n < len(w) and v[i + n] == w[p + n]:
                    n += 1
                if n and n >= min(10, len(v)):
                    out.add((str(item), i, p, n))
    return out


def test_suffix_arrays_are_sorted():
    pick = random.Random(6)
    docs = [[pick.choice([b"a", b"b", b"c"]) for _ in range(pick.randrange(40))] for _ in range(30)] + [[b"a"] * 50, [], [b"a"] * 50]
    s = decontaminate.Shard(docs)
    t = s.words.tolist()
    assert s.order.tolist() == sorted(range(len(t)), key=lambda p: t[p:])


def test_longest_matches_equal_brute_force(spark):
    pick = random.Random(8)
    text = lambda n: " ".join(pick.choice("abcdef") for _ in range(n))
    docs, items = [(i, text(pick.randrange(60))) for i in range(25)] + [(None, text(30)), (3, None)], [(i, text(14)) for i in range(6)] + [(7, "zz a b"), (None, "q")]
    got = decontaminate.longest_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["item"], r["item_at"]): r for r in got}
    for item, t in items:
        v = split(t)
        for i in range(len(v)):
            best = max((n for w in (split(d) for _, d in docs) for p in range(len(w)) for n in range(len(v) - i + 1) if w[p : p + n] == v[i : i + n]), default=0)
            assert ((str(item), i) in found) == (best > 0)
            if best:
                r = found[str(item), i]
                assert r["length"] == best and any(split(d)[r["at"] : r["at"] + best] == v[i : i + best] for k, d in docs if k == r["doc_id"])


def test_decontamination_equals_brute_force(spark, docs):
    pick = random.Random(2)
    words = ["alpha", "Beta", "gámma", "d3", "e", "f"]
    items = [(1, " ".join(pick.choice(words) for _ in range(25))), (2, "alpha"), (3, "d3, e!"), (4, None), (5, "..."), (6, "e " * 30), (7, "e " * 30)]
    texts = [(i, " ".join(pick.choice(words[: 2 + i % 5]) for _ in range(pick.randrange(120)))) for i in range(60)]
    texts += [(100, "x " + items[0][1] + " y"), (101, re.sub("[a-z]+", lambda m: m.group().upper(), items[0][1])), (102, "e " * 500), (103, None), (104, ""), (105, "--"), (106, items[0][1][:40])]
    got = decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert {i: (r["n_words"], r["n_hit"], r["items"]) for i, r in rows.items()} == contaminated_brute(texts, items)
    assert rows[100]["longest"] == rows[101]["longest"] == 25 and rows[103]["longest"] == 0
    for i, text in texts:
        assert {tuple(m) for m in rows[i]["matches"]} == matches_brute(text, items), i
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = contaminated_brute([(r["doc_id"], r["text"]) for r in docs.collect()], bench)
    for r in queries.op9_decontamination(spark, SF).collect():
        n, hit, seen = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(seen), hashlib.sha256(",".join(seen).encode()).hexdigest(), hit > 0)


def test_decontamination_in_small_shards_and_blocks(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(map(str, decontaminate.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK", 2000)
    assert sorted(map(str, decontaminate.contamination(docs, bench).collect())) == want
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.clean(docs, bench).columns == docs.columns


def test_url_rules_and_collisions(spark, tmp_path, monkeypatch):
    rows = [(1, "http://a.EXAMPLE.org/es/x?q"), (2, "https://example.org/en/123"), (3, "http://x.com/fr/1"), (4, "http://x.com/de/"), (5, "http://com/de/x"), (6, "http://ads.example.net/x"), (7, None), (8, "no scheme"), (9, "://"), (10, "http://notexample.org/es/"), (11, "http://b.net/fr"), (12, "http://org?x"), (13, "http://x.com/fr"), (1, "http://a.EXAMPLE.org/es/x?q")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect()}
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/123", "example.org/en/1", "block"), 3: ("x.com", "/fr/1", "com/fr/", "allow"), 4: ("x.com", "/de/", "com/de/", "block"),
        5: ("com", "/de/x", "com/de/", "block"), 6: ("ads.example.net", "/x", None, "block"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("notexample.org", "/es/", "org/", "allow"),
        11: ("b.net", "/fr", None, "allow"), 12: ("org", "", None, "allow"), 13: ("x.com", "/fr", None, "allow"),
    }
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s, *a: 7)  # every digest collides
    url_filter.build(f"{tmp_path}/d.bin", url_filter.RULES, url_filter.BLOCKED)
    array = url_filter.DigestArray(f"{tmp_path}/d.bin")
    assert url_filter.judge(["example.org", "x.net"], ["/es/", "/"], array) == (["example.org/es/", None], ["block", "allow"])
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    assert url_filter.judge([".".join(["a"] * 32_000) + ".example.org", "a.tracker.example.net"], ["/es/", "/x"], array) == (["example.org/es/", None], ["block", "block"])


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    assert [f for _, f in corpus_pipeline.STAGES] == [stages.quality_classifier, stages.near_dedup, stages.decontamination, stages.personal_data, stages.sentencepiece]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages.quality_classifier(spark, docs, SF).collect()}
    assert np.mean([(i in kept) == q for i, q in labels.items()]) >= 0.95
    one = stages.near_dedup(spark, docs, SF)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {i for i, (_, c) in classes(rows, 5, 80).items() if i == c}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, (_, hit, _) in contaminated_brute(rows, bench).items() if not hit}
    assert {r["doc_id"] for r in stages.decontamination(spark, docs, SF).collect()} == clean
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} <= kept and all(len(r["ids"]) == r["n_tokens"] for r in out)


def test_sql_of_the_operators(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, SF)
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        got = sorted(tuple(str(r[c]) for c in names) for r in df.collect())
        assert set(names) == set(df.columns) and got == sorted(tuple(map(str, r)) for r in result.fetchall()), name


@pytest.mark.parametrize("n", [0, 1, 4, 5, 31])
def test_range_buckets_count_the_cuts_below(spark, n):
    cuts = [10 * i for i in range(1, n + 1)]
    rows = spark.range(0, 10 * n + 20).select("id", bucket_of(F.col("id"), cuts).alias("b")).collect()
    assert all(r["b"] == sum(c < r["id"] for c in cuts) for r in rows)


def test_decontamination_takes_no_pairs():
    """Boilerplate in many items and documents, and one word over and over: each range is looked at once."""
    passage = [f"w{i}".encode() for i in range(30)]
    items = [(f"{i:04d}", [*passage, f"i{i}".encode()]) for i in range(800)]
    docs = [[f"d{i}".encode(), *passage] for i in range(800)]
    began = time.perf_counter()
    got = decontaminate.judge_shard(docs, [decontaminate.Tests(items)], 10, False)
    assert time.perf_counter() - began < 30
    assert all(m[:3] == (31, 30, [i for i, _ in items]) for m in got)
    began = time.perf_counter()
    (m,) = decontaminate.judge_shard([[b"a"] * 400_000], [decontaminate.Tests([("x", [b"a"] * 800), ("y", [b"a"] * 3)])], 10, False)
    assert time.perf_counter() - began < 60 and m[:3] == (400_000, 400_000, ["x", "y"])


def test_pii_white_space_does_not_matter():
    for n in (1, 30, 45, 700):
        gap = " " * n
        assert pii.spans(f"10.20.30{gap}[dot] five.")[1] == [("ip", 0, 18 + n)]
        assert pii.spans(f"{gap}10.20.30 [dot]{gap}five.")[1] == [("ip", n, 2 * n + 18)]


def test_pipeline_of_edge_and_empty_tables(spark, edge, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing and further columns, and tables without rows."""
    import corpus_pipeline

    empty_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, None), (1, ""), (2, "same text here")], "item_id long, text string")
    cases = {"edge": (edge.withColumns({"kept": F.lit("x"), "n_hit": F.lit(1), "component_id": F.lit(2), "id": F.lit(3)}), bench), "none": (edge.limit(0), bench), "plain": (edge, bench.limit(0))}
    for name, (docs, items) in cases.items():
        for table, rows in (("documents", docs), ("labels", empty_labels), ("benchmark", items)):
            rows.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    got = {name: corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect() for name in cases}
    assert got["none"] == [] and set(got["edge"][0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"}
    ids = lambda name: sorted((r["doc_id"] for r in got[name]), key=str)
    assert 6 not in ids("edge") and 7 not in ids("edge")  # the benchmark's text
    assert 6 in ids("plain") and 7 not in ids("plain") and ids("plain").count(6) == 1  # a repeat, and its copy
    assert None in ids("edge") and 0 in ids("edge") and 1 in ids("edge")
