"""Personal data, piece codec, packing, media, quality, template extraction and WARC against plain forms and libraries."""

from __future__ import annotations

import collections
import gzip
import hashlib
import html.parser
import http.client
import io
import json
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tesserae.llm import html_template, media, packing, pii, piece_codec, quality, queries, simhash, substring, warc

from .conftest import SF

ODD = [None, "", " ", "\n\t ", "a", "é" * 70, "x " * 3000, "0" * 5000, "ab　c▁d <|endoftext|> </s> 😀\x00", "line\nline\r\n  two  spaces ", "ΑΣ Σ İ ﬁ á ́b"]
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def luhn_ok(digits: str) -> bool:
    return sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's four patterns as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or luhn_ok(digits)):
                out.append((kind, *m.span()))
    return out


PRIVATE = ["mail a.b@c.de or x@y or @a.b a@b@c.d.e", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3.0255 9.9.9", "4111 1111 1111 1111, 4111-1111-1111-1112 card 0000000000000", "call +49 (30) 1234-567 or +1.2.3 or +12345678901234567", "IBAN GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789"]


def test_personal_data(spark, docs, sample):
    texts = ODD + PRIVATE + sample.text.tolist()
    rows = {r.doc_id: r for r in pii.detect(docs(texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        base = base_spans(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest(), t
        for kind in ("email", "ip", "card", "phone"):
            assert rows[i][f"n_{kind}"] == sum(b[0] == kind for b in base)
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(rows[i].spans.split(","))
    assert "iban:5:32" in rows[len(ODD) + 4].spans and "ssn:41:52" in rows[len(ODD) + 4].spans
    assert pii.mask("to a@b.cd, now") == "to <EMAIL>, now" and pii.mask(None) is None
    assert pii.detect(docs(["a"]).limit(0)).count() == 0


def test_pieces_match_the_library(spark, docs, sample):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES, add_eos=True)
    texts = ODD + PRIVATE + sample.text.tolist()
    rows = {r.doc_id: r for r in piece_codec.encode_decode(docs(texts), PIECES).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert rows[i].n_tokens == len(ids), t
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), t
        assert rows[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest(), t


def test_pieces_by_hypothesis():
    import sentencepiece
    from hypothesis import given, settings
    from hypothesis import strategies as st

    sp, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES, add_eos=True), piece_codec.codec(PIECES)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from("aehinorst lndAT.,'\n\t▁é中😀12")))
    def same(t):
        ids, decoded, n = codec.encoded(t)
        assert ids == " ".join(map(str, sp.encode(t))) and decoded.decode("utf-8", "replace") == sp.decode(sp.encode(t))

    same()


def test_packing(spark, docs, sample):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    texts = ODD + PRIVATE + sample.text.tolist()
    rows = packing.pack(docs(texts), WORDS, with_ids=True).collect()
    whole: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        assert r.start == len(whole.setdefault(r.doc_id, []))
        whole[r.doc_id] += ids
        assert r.doc_tokens >= r.start + r.length
    for i, t in enumerate(texts):
        assert whole[i] == tokenizer.encode(t or "", add_special_tokens=False).ids + [2], t
    filled: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert sorted(filled) == list(range(len(filled))) and all(filled[s] == 4096 for s in range(len(filled) - 1))
    assert packing.pack(docs(["a"]).limit(0), WORDS).count() == 0


def test_media(spark, docs, sample):
    texts = ODD + PRIVATE + sample.text.tolist()[:50] + ["y" * 200_000]
    rows = {r.doc_id: r for r in media.store(docs(texts), with_media=True).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(payload), len(r.media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert rows[0].feature == rows[1].feature




def plain_blocks(data: bytes) -> list[list[int]]:
    """Coefficients of an image with a restart after each MCU and no subsampling, read bit by bit."""
    tables, at = {}, 2
    while data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        while data[at + 1] == 0xC4 and body:
            code, k, found = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    found[f"{code:0{length}b}"] = body[k]
                    code, k = code + 1, k + 1
                code *= 2
            tables[body[0]], body = found, body[k:]
        at += 2 + size
    out = []
    for part in re.split(rb"\xff[\xd0-\xd7]", data[at + 2 + int.from_bytes(data[at + 2 : at + 4], "big") : -2]):
        bits, p = "".join(f"{x:08b}" for x in part.replace(b"\xff\0", b"\xff")), 0

        def symbol(table, bits=bits):
            nonlocal p
            length = next(n for n in range(1, 17) if bits[p : p + n] in table)
            p += length
            return table[bits[p - length : p]]

        def number(size, bits=bits):
            nonlocal p
            p += size
            v = int(bits[p - size : p] or "0", 2)
            return v if not size or bits[p - size] == "1" else v - 2**size + 1

        for _ in range(3):
            block = [0] * 64
            block[0], k = number(symbol(tables[0])), 1
            while k < 64:
                rs = symbol(tables[16])
                if rs == 0:
                    break
                k += rs >> 4
                block[k], k = number(rs & 15), k + 1
            out.append(block)
    return out


def test_media_codes():
    rng = np.random.default_rng(4)
    zero = bytes([media.MIDDLE])
    data = [media.padded(bytes(range(256)) * 5), media.padded(b""), zero * 192, b"a" + zero * 30 + b"b" + zero * 160 + b"\xff" * 192, rng.integers(0, 256, 192 * 40, np.uint8).tobytes()]
    made = media.encode(data)
    for payload, image, read in zip(data, made, media.decode(made), strict=True):
        assert [*read.blocks.reshape(-1, 64).tolist()] == plain_blocks(image) and media.payload_of(read) == payload
    assert media.encode(data[1:2]) == made[1:2]
    for bad in (b"no image", made[0][:-40], made[0][:100], made[0].replace(b"\xff\xd1", b"")):
        with pytest.raises(ValueError):
            media.decode([bad])


def test_media_of_another_encoder(spark):
    """Java's own encoder subsamples colour and sets no restarts; thumbnails are the means of the luminance of 8x8 pixels."""
    jvm = spark._jvm
    wide, high = 52, 37
    y, x = np.mgrid[:high, :wide]
    red, green, blue = (128 + 100 * np.sin(x / 17 + y / 29)).astype(int), (x * 3 + y) % 256, (y * 5) % 200
    whole = jvm.java.awt.image.BufferedImage(wide, high, 1)
    for i in range(high):
        for j in range(wide):
            whole.setRGB(j, i, int(red[i, j]) << 16 | int(green[i, j]) << 8 | int(blue[i, j]))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(whole, "jpg", out)
    image = media.decode([bytes(out.toByteArray())])[0]
    assert (image.width, image.height) == (wide, high)
    light = 0.299 * red + 0.587 * green + 0.114 * blue
    for i in range(high // 8):
        for j in range(wide // 8):
            assert abs(light[8 * i : 8 * i + 8, 8 * j : 8 * j + 8].mean() - int(image.thumbnail()[i, j])) < 4
    own = media.encode([media.padded(b"some text " * 200)])[0]
    read = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(own))
    assert (read.getWidth(), read.getHeight()) == (32, 24)
    rows = spark.createDataFrame([(1, bytes(out.toByteArray())), (2, b"none"), (None, None), (1, own), (1, own)], "key long, media binary")
    got = [(r.key, r.width, r.height, r.error) for r in media.described(rows).collect()]
    assert got == [(1, wide, high, None), (2, None, None, "no start of image"), (None, None, None, None), (1, 32, 24, None), (1, 32, 24, None)]
    assert media.described(rows.limit(0)).count() == 0


def test_media_odd_rows(spark, docs):
    rows = media.store(docs([(None, "a"), (3, "x" * 300_000), (3, "b"), (3, "b"), (4, None), (4, "")])).collect()
    assert len(rows) == 6 and [r.n_bytes for r in sorted(rows, key=lambda r: r.n_bytes)] == [0, 0, 1, 1, 1, 300_000]
    assert len({(r.media_sha256, r.feature) for r in rows if r.n_bytes == 0}) == 1
    assert media.store(docs(["a"]).limit(0)).count() == 0


def test_quality(spark, docs):
    found = queries.op5_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = found.merge(labels, on="doc_id")
    assert (found.held_out == found.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()
    held = both[both.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()
    print("held-out AUC", auc, "accuracy", (held.predicted == held.quality).mean())
    assert auc > 0.8
    frame = spark.createDataFrame([(1, 1, None), (None, 1, 0), (2, None, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    odd = quality.scored(docs([*ODD, (1, "again"), (None, "no key")]), frame).collect()
    assert len(odd) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in odd)
    assert [r.score for r in quality.scored(docs(["a"]), frame.limit(0)).collect()] == [0.5]
    assert quality.scored(docs(["a"]).limit(0), frame).count() == 0


def plain_indicators(text: str) -> set[int]:
    """Slots of the n-grams, one by one."""
    data, found = text.encode(), set()
    slot = lambda code, salt: ((code + salt) * 2654435761 % (1 << 32)) >> 14
    for n, salt in ((1, 1 << 25), (2, 1 << 26), (3, 0)):
        found |= {slot(int.from_bytes(data[k : k + n], "big"), salt) for k in range(len(data) - n + 1)}
    run = 1
    words = data.split()
    for a, b in zip(words[:-1], words[1:], strict=True):
        run = run + 1 if a == b else 1
        found |= {slot(n, 1 << 27) for n in range(2, min(run, quality.RUNS) + 1)}
    return found


def test_indicators_and_ratios(sample):
    texts = ["", "a", "ab", "x x x y y", "w " * 40, "é" * 9, *sample.text.fillna("").tolist()[:20]]
    rows = [quality.indicators(t) for t in texts]
    assert [set(r.tolist()) for r in rows] == [plain_indicators(t) for t in texts]
    y = [1.0 if k % 3 else -1.0 for k in range(len(texts))]
    ratio = quality._ratios(rows, np.array(y))
    counts = {label: collections.Counter(s for t, v in zip(texts, y, strict=True) if v == label for s in plain_indicators(t)) for label in (1.0, -1.0)}
    total = {label: quality.SLOTS + sum(c.values()) for label, c in counts.items()}
    for s in set().union(*map(plain_indicators, texts)):
        want = np.log((1 + counts[1.0][s]) / total[1.0]) - np.log((1 + counts[-1.0][s]) / total[-1.0])
        assert abs(ratio[s] - want) < 1e-12


def test_sample_takes_each_key_once(spark, docs, monkeypatch):
    monkeypatch.setattr(quality, "FIT", 6)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, labels: seen.append((len(rows), sorted(labels))))
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(k, 1) for k in range(30)], "doc_id long, quality int")
    quality.train(docs([(k, f"text {k} {n}") for k in range(30) for n in range(9)]), labels)
    assert seen[0][0] == 6


def test_dual_descent_meets_its_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 8)) for _ in range(60)]
    y = np.where([3 in r or 7 in r for r in rows], 1.0, -1.0)
    ratio = quality._ratios(rows, y)
    w = quality._descend(rows, y, ratio, rounds=500)
    scaled = np.zeros((60, quality.SLOTS))
    for k, r in enumerate(rows):
        scaled[k, r] = ratio[r] / len(r) ** quality.POWER
    cost = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    primal = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (scaled @ v))).sum()
    assert all(primal(w) <= primal(w + 1e-2 * rng.standard_normal(len(w)) * (w != 0)) + 1e-3 for _ in range(20))


PAGE = "<html><head><title>T</title><script>x<y</script></head><body><nav><a>Home</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; line {k}</h1><p>One  {k} two<br>three<p>Four &#233;{k}</article><div class=comments><p>Nice!</div><footer>(c)</footer></body></html>"


def test_template_extraction(spark):
    rows = [(k, f"http://h{k % 2}.example.org/{k}", PAGE.replace("{k}", str(k))) for k in range(12)] + [(100, None, None), (101, "::bad::", ""), (102, "http://h0.example.org/x", "plain text only"), (0, "http://h0.example.org/0", PAGE.replace("{k}", "0"))]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, slot string, host string")
    found = html_template.extract(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.page_id < 100:
            assert r.text == f"Head & line {r.page_id}\nOne {r.page_id} two three\nFour é{r.page_id}"
        elif r.page_id < 102:
            assert (r.text, r.n_chars) == ("", 0)
        assert r.n_chars == len(r.text)
    assert html_template.extract(pages.limit(0)).count() == 0


def test_template_decides_slots_and_own_text(spark):
    def page(k):
        return f"<html><body><div class=top>Brand</div><article class=lead><p>Lead {k}<p>Read <b>more</b> on our app</article><article class=more><p>More {k}{'<p>Seen twice' if k < 2 else ''}</article><p>Outside {k}</body></html>"

    def teaser(k):
        return f"<html><body><article class=teaser><p>T {k}</article><div class=text><p>{'Long text of the page. ' * 9}{k}</div></body></html>"

    rows = [(k, "http://a.example/", page(k)) for k in range(12)] + [(k, "http://b.example/", page(99)) for k in range(20, 35)] + [(k, "http://c.example/", teaser(k)) for k in range(40, 52)]
    found = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k] == f"Lead {k}\nMore {k}" + "\nSeen twice" * (k < 2) for k in range(12))
    # Fifteen copies of one page are no evidence that its text is the template's.
    assert all(found[k] == "Lead 99\nRead more on our app\nMore 99" for k in range(20, 35))
    assert all(found[k] == ("Long text of the page. " * 9) + str(k) for k in range(40, 52))


def test_boilerplate_goes_by_whole_names_that_recur(spark):
    kept = ["<h2 id='related-work'>A{k}</h2>", "<section id='search-algorithms'>B{k}</section>", "<div class='side-by-side'>C{k}</div>", "<section id='social-history'>D{k}</section>", "<p class='notice-period'>E{k}</p>", "<h2 class=related>F{k}</h2>", "<p><span class=notice>G{k}</span></p>", "<div data-role='related'>H{k}</div>", "<p><math><mi>x{k}</mi></math></p>", "<p><object>I{k}</object></p>", "<noscript>J{k}</noscript>"]
    gone = ["<div class='box related'>Z{k}</div>", "<div class='site-footer'>Z{k}</div>"]

    def page(k):
        return "<html><body><article>" + "".join(kept + gone).replace("{k}", str(k)) + ("<section id=social>Once</section>" if k == 3 else "") + "</article></body></html>"

    rows = [(k, "http://a.example/", page(k)) for k in range(6)] + [(9, "http://b.example/", page(9))]
    found = {r.page_id: r.text.split("\n") for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, text in found.items():
        assert text == [f"{x}{k}" for x in "ABCDEFGHxIJ"] + ["Once"] * (k == 3)


WORDS_OF_STORIES = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def story(k: int, n: int = 30) -> str:
    return " ".join(WORDS_OF_STORIES[(k * 7 + i * i * (k + 3)) % 14] + str(k) for i in range(n))


#: Pages of one host each, and what is their text: fixed parts around and inside the story, teasers, forms around pages.
HOSTS = {
    "fixed-around": lambda k: (f"<html><body><div class=wrap><p>Brought to you by our partner</p><div class=text><p>{story(k)}<p>{story(k + 50)}</div><p>All rights reserved</p></div></body></html>", [story(k), story(k + 50)]),
    "fixed-inside": lambda k: (f"<html><body><article><h1>Title {k}</h1><p>{story(k)}</p><div class=box><p>Join our club today</p></div><p>{story(k + 9)}</p></article></body></html>", [f"Title {k}", story(k), story(k + 9)]),
    "teaser": lambda k: (f"<html><body><main><article class=teaser><p>Teaser {k}</p></article><div class=story><p>{story(k, 90)}</p></div></main></body></html>", [f"Teaser {k}", story(k, 90)]),
    "wrapping-form": lambda k: (f"<html><body><form id=aspnetForm><div class=menu><a href=x>Home</a></div><div class=cnt><p>{story(k)}</p></div></form></body></html>", [story(k)]),
    "own-form": lambda k: (f"<html><body><article><p>{story(k)}</p><form><p>Write to us {k}</p></form></article></body></html>", [story(k)]),
    "names": lambda k: (f"<html><body><article><p class=related-work>Related {story(k)}</p><div class=side-effects><p>Side {story(k + 5)}</p></div><h2 id=comment>Head {k}</h2></article></body></html>", [f"Related {story(k)}", f"Side {story(k + 5)}", f"Head {k}"]),
    "without-names": lambda k: (f"<html><body><div class=a><a href=1>Sports</a> <a href=2>News</a></div><div class=b><p>{story(k, 60)}</p><p>{story(k + 3, 60)}</p></div><div class=c>Imprint</div></body></html>", [story(k, 60), story(k + 3, 60)]),
}


def hosts(spark, n: int):
    return spark.createDataFrame([(f"{name} {k}", f"http://{name}.example/{k}", made(k)[0]) for name, made in HOSTS.items() for k in range(n)], "page_id string, url string, html string")


@pytest.mark.parametrize("n", [8, 3, 2])
def test_fixed_parts_teasers_forms_and_names(spark, n):
    found = {r.page_id: r.text for r in html_template.extract(hosts(spark, n)).collect()}
    for name, made in HOSTS.items():
        for k in range(n):
            assert found[f"{name} {k}"] == "\n".join(made(k)[1]), name
    without = {f"{name} {k}": html_template.article(made(k)[0], [], [], set(), None) for name, made in HOSTS.items() for k in range(n)}
    assert {x.split()[0] for x in found if found[x] != without[x]} == {"fixed-around", "fixed-inside", "teaser", "without-names"}


def test_hosts_of_two_and_comments_of_one_page(spark):
    def pair(k):
        return f"<html><body><div class=wrap><p>The Daily Page</p><div class=text><p>{story(k)}<p>{story(k + 50)}</div><div class=advert><p>Buy {story(k + 7)}</p></div><p>All rights reserved</p></div></body></html>"

    def talk(k):
        comments = f"<div class=comments><p>Reader Bob says nice piece number {k}</p></div><div class='box cookie-notice'>We use cookies</div>" if k == 4 else ""
        return f"<html><body><div class=text><p>{story(k, 60)}</p></div>{comments}</body></html>"

    rows = [(f"a{k}", "http://a.example/", pair(k)) for k in range(2)] + [(f"b{k}", "http://b.example/", talk(k)) for k in range(6)] + [("c", "http://c.example/", talk(4)), ("d", "http://d.example/", f"<body><div class='ad box'><p>{story(1)}</p></div></body>")]
    found = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert found == {f"a{k}": f"{story(k)}\n{story(k + 50)}" for k in range(2)} | {f"b{k}": story(k, 60) for k in range(6)} | {"c": story(4, 60), "d": story(1)}


def test_pages_of_any_nesting_are_read_in_one_pass():
    n = 100_000
    for page in (f"<body><article><p>{'<span>' * n}deep text</article>", "<div>" * n + "deep text", "<b><p>" * n + "deep text" + "</b>" * n, "<div class=related>" * n + "deep text", "<i>" * n + "x</p>" * n + "<p>deep text"):
        began = time.time()
        assert "deep text" in html_template.article(page, [], [], set(), set())
        assert time.time() - began < 5


class Articles(html.parser.HTMLParser):
    """Blocks of text within <article>, read by the standard library; pages of the test tables have no more in them."""

    def __init__(self, page: str):
        super().__init__()
        self.inside, self.skip, self.blocks = 0, 0, [""]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("script", "style", "aside", "nav", "form", "footer")
        if tag in html_template.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style", "aside", "nav", "form", "footer")
        if tag in html_template.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data


def test_extracted_text_agrees_with_a_plain_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r.text for r in queries.op1_html(spark, "/root/testdata/sf0.01").collect()}
    want = {r.page_id: "\n".join(x for x in (" ".join(b.split()) for b in Articles(r.html or "").blocks) if x) for r in pages.collect()}
    assert found == want


def plain_templates(pages: list[tuple[str, str, str]]) -> dict[str, tuple]:
    """(slots, texts, named) of each host (host, key, html), from whole occurrence vectors."""
    out = {}
    for host in {h for h, _, _ in pages}:
        own = [(key, page) for h, key, page in pages if h == host]
        copies = len(own) - len({page for _, page in own})
        vectors, places = collections.defaultdict(list), collections.defaultdict(list)
        for key, page in own:
            for token, row in html_template._profile(page).items():
                vectors[token].append((key, row[0]))
                places[token].append(row)
        named = {t[1:] for t, v in vectors.items() if t[0] == "!" and len(v) >= 2}
        enough = lambda t, v, own=own, copies=copies: len(v) >= 2 and 2 * len(v) >= len(own) and (t[0] != "#" or (len(v) - copies >= 2 and 2 * (len(v) - copies) >= len(own) - copies))
        tokens = {t: sorted(v) for t, v in vectors.items() if t[0] != "!" and enough(t, v)}
        mean = {t: [sum(r[i] for r in places[t]) / len(places[t]) for i in (1, 2)] for t in tokens}
        classes: dict[tuple, list[str]] = {}
        for t in sorted(tokens, key=lambda t: (mean[t][0], t)):
            classes.setdefault(tuple(tokens[t]), []).append(t)
        ranked = sorted(classes.values(), key=lambda g: (-len(tokens[g[0]]), -len(g), min(mean[t][0] for t in g), g[0]))
        chosen: list[tuple[float, float, list[str]]] = []
        for g in ranked:
            lo, hi = min(mean[t][0] for t in g), max(mean[t][1] for t in g)
            if (len(g) > 1 or len(tokens[g[0]]) == max(map(len, tokens.values()))) and all(hi <= a or lo >= b or a <= lo <= hi <= b or lo <= a <= b <= hi for a, b, _ in chosen):
                chosen.append((lo, hi, g))
        valid = {t for _, _, g in chosen for t in g}
        out[host] = ({t for t in valid if t[0] == "#"}, named, {t for t in valid if t[0] == "/"})
    return {h: x for h, x in out.items() if x[2]}


def test_templates_agree_with_whole_occurrence_vectors(spark):
    made = [(r.url.split("/")[2], r.page_id, r.html) for r in hosts(spark, 6).collect()]
    given = [(r.url.split("/")[2], str(r.page_id), r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    copied = [("copies.example", str(k), HOSTS["fixed-inside"](k // 4)[0]) for k in range(20)]
    pages = made + given + copied
    want = plain_templates(pages)
    found = {r.host: r for r in html_template.templates(spark.createDataFrame(pages, "host string, name string, page string")).where("host <> '*'").collect()}
    assert found.keys() == want.keys() and len(want) > 30
    for host, (texts, named, roles) in want.items():
        r = found[host]
        assert set(r.texts) == texts and set(r.named or ()) == named and r.roles == len(roles) and set(r.slots) <= roles, host


def test_equal_occurrence_vectors_form_one_class():
    import pandas as pd

    roles = pd.DataFrame([("h", f"/html/body/{x}", 3, v, v, float(f), float(l), n, 0, b) for x, v, f, l, n, b in (("article", 5, 2, 6, 0, False), ("article/p", 5, 3, 5, 900, False), ("nav", 9, 0, 1, 50, True))], columns=["host", "role", "n", "v1", "v2", "first", "last", "letters", "linked", "bad"])
    made = html_template._template(roles)
    assert made.slot.tolist() == ["/html/body/article"] and made.roles.tolist() == [3]


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record that another library's parser of headers reads."""
    version, _, rest = data.partition(b"\r\n")
    assert version == b"WARC/1.0"
    source = io.BytesIO(rest)
    headers = dict(http.client.parse_headers(source).items())
    block = source.read(int(headers["Content-Length"]))
    assert source.read() == b"\r\n\r\n"
    return headers, block


class Visible(html.parser.HTMLParser):
    """Words of a simple page, read by the standard library."""

    def __init__(self, page: str):
        super().__init__()
        self.hidden, self.out = 0, []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_warc_derivatives(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", PAGE, "x"), (2, None, None, "x"), (None, "http://b\r\nX: y", "<a href='/z?a=1&amp;b'>t</a>", "x"), (1, "http://a.example/x", PAGE, "x"), (3, "u", "<p>long page</p>" * 60_000, "x")], "page_id long, url string, html string, record string")
    given = {r.page_id: r.html for r in pages.collect()}
    sources = {x[0]["WARC-Record-ID"]: x for r in warc.responses(pages).collect() for x in [read_record(bytes(r.record))]}
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(made) == 10 and {r.error for r in made} == {None}
    for r in made:
        headers, body = read_record(bytes(r.record))
        source, block = sources[r.refers_to]
        assert headers["WARC-Refers-To"] == r.refers_to == source["WARC-Record-ID"]
        assert headers["WARC-Target-URI"] == headers.get("WARC-Refers-To-Target-URI", "") == source["WARC-Target-URI"] if source["WARC-Target-URI"] else "WARC-Target-URI" not in headers
        assert headers["WARC-Date"] == headers["WARC-Refers-To-Date"] == source["WARC-Date"]
        assert headers["WARC-Source-Payload-Digest"] == warc.sha1(block.partition(b"\r\n\r\n")[2])
        assert headers["WARC-Block-Digest"] == warc.sha1(body)
        if r.warc_type == "metadata":
            json.loads(body)
        else:
            assert body.decode().split() == " ".join(Visible(given[r.page_id] or "").out).split() or r.page_id == 1
    assert len({r.record_id for r in made}) == 10 and len(sources) == 5
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def a_record(kind: str = "response", http_head: bytes = b"Content-Type: text/html", payload: bytes = b"<p>one</p>", more: bytes = b"WARC-Record-ID: <urn:1>\r\n") -> bytes:
    block = b"HTTP/1.1 200 OK\r\n" + http_head + b"\r\n\r\n" + payload
    return b"WARC/1.1\r\nwarc-type: " + kind.encode() + b"\r\n" + more + b"WARC-target-uri: http://x/\r\ncontent-length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("record, want", [
    (a_record(), "one"),
    (a_record(kind="request"), None),
    (a_record(http_head=b"content-type: text/html; charset=no-such"), "one"),
    (a_record(http_head=b"Content-Type: text/html; charset=hex"), "one"),
    (a_record(http_head=b"content-TYPE: text/html; Charset=\"ISO-8859-1\"", payload=b"<p>caf\xe9"), "café"),
    (a_record(http_head=b"Content-Type: text/html", payload=b"<meta charset=latin-1><p>caf\xe9"), "café"),
    (a_record(http_head=b"Content-Type: text/html\r\nContent-Encoding: gzip", payload=gzip.compress(b"<p>packed")), "packed"),
    (a_record(http_head=b"Content-Type: text/html\r\nContent-Encoding: gzip", payload=b"<p>not packed"), "not packed"),
    (a_record(http_head=b"Transfer-Encoding: chunked", payload=b"4\r\n<p>a\r\n2;x=y\r\nbc\r\n0\r\n\r\n"), "abc"),
    (a_record(http_head=b"Content-Type: text/plain", payload=b"a  <b>"), "a  <b>"),
    (a_record(http_head=b"Content-Type: image/png", payload=b"\x89PNG"), ""),
    (a_record(http_head=b"Content-Type: text/html\r\nContent-Encoding: br", payload=b"\x0b\x02\x80<p>x"), ""),
    (b"HTTP/1.1 200", ValueError), (a_record()[:-30], ValueError), (a_record().replace(b"content-length", b"length"), ValueError), (a_record(more=b""), ValueError), (b"", ValueError),
])
def test_warc_records_of_others(record, want):
    if want is ValueError:
        with pytest.raises(ValueError):
            warc.derive(record)
        return
    made = {r[0]: r for r in warc.derive(record)}
    assert set(made) == (set() if want is None else {"metadata", "conversion"} if want else {"metadata"})
    if want:
        assert read_record(made["conversion"][5])[1].decode() == want


def test_warc_keeps_headers_that_repeat():
    head = b"Content-Type: text/html\r\nSet-Cookie: a=1\r\nset-cookie: b=2"
    more = b"WARC-Record-ID: <urn:1>\r\nWARC-Concurrent-To: <urn:2>\r\nwarc-concurrent-to: <urn:3>\r\n"
    made = {r[0]: r[5] for r in warc.derive(a_record(http_head=head, more=more))}
    for data in made.values():
        headers, block, _ = warc.parse(data)
        assert [v for k, v in headers if k.lower() == "warc-concurrent-to"] == ["<urn:2>", "<urn:3>"]
    envelope = json.loads(warc.parse(made["metadata"])[1])["Envelope"]
    assert [v for k, v in envelope["WARC-Header-Metadata"] if k.lower() == "warc-concurrent-to"] == ["<urn:2>", "<urn:3>"]
    assert [v for k, v in envelope["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"] if k.lower() == "set-cookie"] == ["a=1", "b=2"]


def test_warc_files_of_many_members():
    """A copy of the rest of the file for each member would take minutes."""
    member = gzip.compress(a_record(payload=np.random.default_rng(1).bytes(17_000)), 0)
    began = time.time()
    found = list(warc._split(member * 4_000))
    assert len(found) == 4_000 and all(e is None for _, e in found) and time.time() - began < 10
    assert [e is None for _, e in warc._split(member * 2 + member[:-9])] == [True, True, False]


def test_warc_files(spark):
    many = [a_record(), a_record(kind="warcinfo"), a_record(payload=b"<p>two")]
    packed = b"".join(gzip.compress(r) for r in many)
    files = [("plain", b"".join(many)), ("packed", packed), ("cut", packed[:-60]), ("other", b"".join(many) + b"junk"), ("empty", b""), ("null", None)]
    got: dict[str, list] = {}
    for r in warc.records(spark.createDataFrame(files, "path string, content binary")).orderBy("path", "position").collect():
        got.setdefault(r.path, []).append(None if r.record is None else bytes(r.record))
    assert got == {"plain": many, "packed": many, "cut": [*many[:2], None], "other": [*many, None]}
    rows = spark.createDataFrame([(1, a_record()), (2, b"junk"), (None, None), (None, a_record())], "page_id long, record binary")
    assert sorted((str(r.page_id), str(r.warc_type), str(r.error)) for r in warc.derivatives(rows).collect()) == [("1", "conversion", "None"), ("1", "metadata", "None"), ("2", "None", "no WARC record"), ("None", "conversion", "None"), ("None", "metadata", "None")]


TABLE_OPERATORS = {
    "pii": pii.detect, "pieces": lambda d: piece_codec.encode_decode(d, PIECES), "simhash": simhash.components, "substring": substring.removed, "media": media.store,
    "packing": lambda d: packing.pack(d, WORDS).where("start = 0").select("doc_id", "doc_tokens"),
}


@pytest.mark.parametrize("name", TABLE_OPERATORS)
def test_null_keys_repeated_rows_and_empty_tables(docs, name):
    rows = [(None, "a b"), (None, None), (3, "x y"), (3, "x y"), (4, ""), (4, None), (5, "long " * 50_000), (6, "x y")]
    run = TABLE_OPERATORS[name]
    got: dict[int | None, list] = {}
    for r in run(docs(rows)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert {k: len(v) for k, v in got.items()} == {None: 2, 3: 2, 4: 2, 5: 1, 6: 1}
    assert got[3][0] == got[3][1] == got[6][0] and got[4][0] == got[4][1]
    assert run(docs(["a"]).limit(0)).count() == 0


def test_queries_cover_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_pii", "op10_media", "op8_substring", "op4_simhash"):
        assert queries.QUERIES[name](spark, SF).count() == n
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert queries.QUERIES["op1_html"](spark, SF).count() == pages and queries.QUERIES["op6_warc"](spark, SF).count() == 2 * pages
    assert queries.QUERIES["op1_html"](spark, SF).where(F.length("text") == 0).count() < pages / 10
