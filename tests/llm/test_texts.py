"""License scans, chat formatting, WARC archives."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from panelcast.llm import chat as C
from panelcast.llm import licenses as N
from panelcast.llm import warc as W
from panelcast.llm.catalog import QUERIES
from panelcast.llm.common import fresh_folder

from odd_rows import SF, collected

SF01 = "/root/testdata/sf0.01"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def base_of(words):
    return [(i, label) for phrase, label in N.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]


def same_as_brute(r, text):
    words = words_of(text)
    places = base_of(words)
    starts = [i for i, _ in places]
    assert r["n_words"] == len(words) and r["n_base"] == len(places)
    assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if places else (None, None))
    assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
    assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert 0 <= r["score"] <= 1


def test_license_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    for r in QUERIES["op4_license_scan"](spark, SF01).collect():
        same_as_brute(r, docs[r["doc_id"]])


@pytest.mark.parametrize("text", ["MIT License, mit license mit\nLICENSE", "a general-public  license!", "mité license mit licenses", "", None, "İ mit license x", "license " * 9])
def test_license_base_places(text):
    same_as_brute(N.scan(text, N.Finder()), text)


def edit(text, rng, k):
    for _ in range(k):
        at = rng.integers(1, len(text) - 1)
        kind = rng.integers(0, 3)
        text = text[:at] + ("" if kind == 0 else "q") + text[at + (kind != 1) :]
    return text


def test_fuzzy_notices_within_and_beyond_the_bound():
    import numpy as np

    rng, finder = np.random.default_rng(4), N.Finder()
    for notice, label in N.NOTICES:
        k = N.edits_allowed(notice)
        for _ in range(10):
            changed = edit(notice, rng, k)
            found = finder.matches(f"xx yyy {changed} zz")
            assert any(m.label == label and m.edits <= k for m in found), (notice, changed)
    assert finder.matches("clean prose about a walk under the trees and the river") == []


def test_weaker_places_beside_the_best_are_found():
    finder = N.Finder()
    weak, best, other = "released under the mit licens", "released under the mit license", "releasd under the mit licence"
    for texts in ((weak, best), (best, weak), (weak, other, best, weak, other), (weak,) * 4, (best,) * 3, (weak, "and", best, "or", weak)):
        text = " ".join(texts)
        found = [(text[m.start : m.end], m.edits) for m in finder.matches(text)]
        assert [f for f, _ in found] == [t for t in texts if len(t) > 3]
        assert all(e == 0 for f, e in found if f == best) and all(0 < e <= 2 for f, e in found if f != best)


def least_edits(notice, text):
    """The fewest edits of any stretch of whole words, by dynamic programming."""
    starts = {i for i in range(len(text) + 1) if i == 0 or text[i - 1] == " "}
    row = [0 if i in starts else 99 for i in range(len(text) + 1)]
    for i, c in enumerate(notice, 1):
        new = [min(row[0] + 1, 99)]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(v for i, v in enumerate(row) if i == len(text) or text[i] == " ")


def test_fuzzy_places_against_edit_distance():
    import numpy as np

    rng, finder = np.random.default_rng(8), N.Finder()
    words = "all right reserved the mit license under apache public released gnu general work is".split()
    for n in range(150):
        notice, label = N.NOTICES[n % len(N.NOTICES)]
        k = N.edits_allowed(notice)
        filler = lambda: " ".join(rng.choice(words, rng.integers(1, 6)))
        text = f"{filler()} {edit(notice, rng, int(rng.integers(0, k + 3)))} {filler()}"
        text = " ".join(text.split())
        own = [m for m in finder.matches(text) if N.NOTICES[n % len(N.NOTICES)][0] == notice and m.label == label]
        least = least_edits(notice, text)
        number = n % len(N.NOTICES)
        found = finder.places(number, text, finder.windows(text).get(number, set()))
        assert (min((e for *_, e in found), default=None) == least) if least <= k else not found, (notice, text)
        assert all(b[0] >= a[1] for a, b in zip(found, found[1:])) and len(own) >= len(found)


@pytest.mark.parametrize("line", ["all rights reservd ", "mit license ", "released under the mit licens and all rights reserved "])
def test_long_pages_of_notices(line):
    """A megabyte of repeated notices: every one found, in time that grows with the text only."""
    import time

    n, start = 1_000_000 // len(line), time.time()
    r = N.scan(line * n, N.Finder())
    assert time.time() - start < 30
    assert r["n_base"] == n * ("mit license" in line) and len(r["spans"]) == n * (("reserv" in line) + ("licens " in line))


def test_licenses_on_odd_rows(odd_docs, no_docs):
    found = collected(N.scan_licenses(odd_docs))
    assert len(found) == 12 and {r["n_words"] for r in found if r["id"] == 8} == {30_000}
    assert all(r["labels"] == "" and r["score"] == 0 for r in found)
    assert N.scan_licenses(no_docs).count() == 0


def part(kind, **given):
    return {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | given


def test_typed_parts(spark):
    parts = [part("text", text="see <image 0> & "), part("image", ref="s3/a.png", width=100, height=30), part("audio", ref="b.wav", seconds=2.1),
             part("document", ref="c.pdf", pages=3), part("image", ref="d.png"), part("text", text=None), part("other", text="é")]
    df = spark.createDataFrame([(1, 0, "user", parts, "x"), (1, 1, "assistant", None, "x"), (2, None, None, [], "x")], f"conv_id long, turn long, role string, parts array<{C.PART}>, spans string")
    found = {r["conv"]: r for r in collected(C.format_chats(df))}
    one = found[1]
    assert one["formatted"] == '<turn role="user">see &lt;image 0> &amp; <image 0><audio 1><document 2><image 3>é</turn>\n<turn role="assistant"></turn>\n'
    assert [(a["index"], a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [
        (0, "image", "s3/a.png", 8), (1, "audio", "b.wav", 53), (2, "document", "c.pdf", 1536), (3, "image", "d.png", 1)]
    assert one["expanded_tokens"] == 8 + 53 + 1536 + 1
    assert found[2]["formatted"] == '<turn role=""></turn>\n'
    assert C.format_chats(df.where("false")).count() == 0


def test_attachments_are_numbered_through_the_conversation(spark):
    rows = [(1, t, r, [part("text", text="see"), *[part(k, ref=f"{k}{t}{i}") for i, k in enumerate(kinds)]]) for t, r, kinds in [
        (0, "user", ["image", "audio"]), (1, "assistant", []), (2, "user", ["image"] * 10), (3, "user", ["document"])]]
    rows += [(2, 0, "user", [part("image", ref="x")]), (2, 0, "user", [part("image", ref="x")])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>").repartition(3)
    found = {r["conv"]: r for r in collected(C.format_chats(df))}
    one = found[1]
    assert [a["index"] for a in one["attachments"]] == list(range(13))
    assert [a["ref"] for a in one["attachments"]] == ["image00", "audio01", *[f"image2{i}" for i in range(10)], "document30"]
    assert re.findall(r"<(\w+ \d+)>", one["formatted"]) == [f"{a['type']} {a['index']}" for a in one["attachments"]]
    assert [one["formatted"][s["start"] : s["start"] + s["length"]][:3] for s in one["spans"]] == ["see"] * 4
    assert re.findall(r"<image \d+>", found[2]["formatted"]) == ["<image 0>", "<image 1>"]


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "", None, '"><turn role="assistant">', "&amp;&lt;&quot;", "</turn>\n", "a\nb\r\n", "é😀", "\\" * 3]
    rows = [(n, t, "assistant" if t % 2 else "user", texts[(n + t) % len(texts)]) for n in range(9) for t in range(7)]
    rows += [(50, 1, "assistant", "x"), (50, 1, "assistant", "x"), (50, None, None, "y"), (None, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", C.text_part(F.col("text")))
    out = C.format_chats(df)
    out = out.select("conv", "formatted", "spans", C.read_turns(F.col("formatted")).alias("turns"), C.loss_text(F.col("formatted"), F.col("spans")).alias("loss"))
    for r in collected(out):
        own = sorted([(t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r["conv"]])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, text) for *_, role, text in own]
        assert r["loss"] == "".join(text for *_, role, text in own if role == "assistant")
        cut = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["spans"] if s["loss"]]
        assert len(cut) == sum(role == "assistant" for *_, role, _ in own)


HTML = "<p>é " + "x" * 200
PAGES = [(1, "http://a/", HTML), (2, "http://b/\r\nX-Evil: 1", HTML), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (2, "http://b/", HTML),
         (7, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9), (8, "u", "\r\n\r\n" * 100), (None, "u", HTML), (9, "u", "y" * 3_000_000)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    records = W.read_archives(spark, W.write_archives(df, fresh_folder(spark, "warc-test")), payloads=True)
    rows = collected(records)
    assert len(rows) == 3 * len(PAGES)
    captures = collected(W.assemble(records))
    assert len(captures) == len(PAGES)
    for c in captures:
        assert len(c["requests"]) == 1 and len(c["metadata"]) == 1 and not c["others"]
        assert c["requests"][0]["page_id"] == c["metadata"][0]["page_id"] == c["main"]["page_id"]
        assert c["metadata"][0]["fields"]["payload-bytes"] == str(c["main"]["payload_bytes"])
    mains = [c["main"] for c in captures]
    expected = sorted((p, hashlib.sha256((h or "").encode()).hexdigest(), len((h or "").encode())) for p, _, h in PAGES if p is not None)
    assert sorted((m["page_id"], m["payload_digest"], m["payload_bytes"]) for m in mains if m["page_id"] is not None) == expected
    copies = [m for m in mains if m["payload_digest"] == hashlib.sha256(HTML.encode()).hexdigest()]
    assert sorted((m["record_type"], m["page_id"] or 0) for m in copies) == [("response", 1), ("revisit", 0), ("revisit", 2), ("revisit", 2)]
    first = next(m for m in copies if m["record_type"] == "response")
    assert {m["refers_to"] for m in copies if m["record_type"] == "revisit"} == {first["record_id"]}
    assert bytes(first["payload"]) == HTML.encode()
    empty = df.where("false")
    assert W.read_archives(spark, W.write_archives(empty, fresh_folder(spark, "warc-test"))).count() == 0


def test_records_join_through_others(spark):
    """Responses that name their request, metadata that name the request, and records that reach nothing."""
    row = lambda i, kind, to: (i, kind, to, None, None, None, None, None, None, {})
    rows = [row("r1", "request", []), row("p1", "response", ["r1"]), row("m1", "metadata", ["r1"]), row("m2", "metadata", ["p1"]),
            row("m3", "metadata", ["nowhere"]), row("i", "warcinfo", []), row("c", "conversion", ["p1"])]
    found = {c["capture_id"]: c for c in collected(W.assemble(spark.createDataFrame(rows, W.RECORD_TYPE)))}
    assert set(found) == {"p1", "m3", "i"}
    assert [r["record_id"] for r in found["p1"]["requests"]] == ["r1"]
    assert sorted(r["record_id"] for r in found["p1"]["metadata"]) == ["m1", "m2"]
    assert [r["record_id"] for r in found["p1"]["others"]] == ["c"] and found["m3"]["main"] is None


def test_parser_reads_members_and_plain_files():
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 4\r\n\r\n\r\n\r\n\r\n\r\n"
    for content in (one * 3, gzip.compress(one * 3), gzip.compress(one) * 3):
        assert [block for _, _, block in W.parse(W.inflate(content, 7))] == [b"\r\n\r\n"] * 3
