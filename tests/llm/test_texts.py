"""Tokens, packing, archives, personal data and licences."""

import base64
import hashlib
import re
import subprocess
import sys
import textwrap
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluicebox.llm import bpe, packing
from sluicebox.llm.licenses import MAY, PARTS, SENTENCES, scan
from sluicebox.llm.pii import KEY_SETTING, PATTERN, feistel, pseudonymised, session_key
from sluicebox.llm.warc import read_records, write_archives

from .conftest import TEXTS

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["<|endoftext|>", "<|startoftext|>", "'ll", "'S", "re", " the", "  ", "aaaa", "hello", "\n\n", "''s", "1", "é", "é", "漢字", "\x1c", "\x85", "　", "\U0001f600", "İ", "٣½", "?!", "\r\n"]


def odd_texts(draw):
    out = ["".join(draw.choice(PIECES) for _ in range(draw.randrange(40))) for _ in range(600)]
    out += ["".join(chr(draw.choice((97, 98, 32, 10, 0x1F600, 0xE9)) + draw.randrange(3)) for _ in range(draw.randrange(80))) for _ in range(400)]
    return [*out, "a" * 5000, "ab" * 3000, " " * 2000 + "x", "\n" * 500, "".join(chr(draw.randrange(1, 0x2FFF)) for _ in range(5000))]


def test_byte_bpe_equals_the_library(draw):
    texts, mine, library = odd_texts(draw), bpe.ByteBPE(BYTE, remembered=500), Tokenizer.from_file(BYTE)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == want.ids, repr(text)
        assert mine.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)
    broken = [draw.randrange(50_256) for _ in range(3000)]
    assert mine.decode(broken) == library.decode(broken, skip_special_tokens=False)


def test_word_bpe_equals_the_library(draw):
    texts, mine, library = odd_texts(draw), packing.WordTokenizer(WORD, remembered=500), Tokenizer.from_file(WORD)
    want = library.encode_batch(texts, add_special_tokens=False)
    for text, got, ids in zip(texts, mine.encode_all(texts), want, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids.ids, repr(text)


def test_words_are_learnt_once_whatever_marks_stand_by_them(draw):
    words = ["plain", "élan", "straße", "naïve"]
    marks = ["", ".", "***", ".%%%", ")", "'", "’s", "'s", "1", "×", "÷", "é", "\u0301", "=\u0338"]
    texts = [" ".join(before + w.title() + after for w in words) for before in ("", "(", "2", "-'") for after in marks]
    mine, library = packing.WordTokenizer(WORD), Tokenizer.from_file(WORD)
    got = [np.frombuffer(ids, "<u4").tolist() for ids in mine.encode_all([*texts, None])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]
    mine = packing.WordTokenizer(WORD)
    list(mine.encode_all([w + mark for w in words for mark in ("***", ".%%%", "$!", "?")]))
    assert set(mine.known) - {""} == {*words, "***", ".%%%", "$!", "?"}


def test_a_worker_stays_small_while_it_cuts_many_distinct_words():
    """Two workers and the JVM share an executor's memory: texts of 20 MB, with many new words, may add little to a worker's."""
    program = """
import random, re, sys
import numpy as np, pandas, pyarrow as pa
from sluicebox.llm import packing

def memory(of):
    return int(re.search(of + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

class Source:
    dtypes = [("id", "bigint")]
    def mapInArrow(self, run, schema):
        return run

draw = random.Random(5)
def batches():
    for _ in range(40):
        words = [" ".join(f"{draw.randrange(16**5):05x}"[:draw.randrange(2, 6)] + draw.choice(["", ",", "."]) for _ in range(2000)) for _ in range(50)]
        yield pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(words)], ["id", "text"])

packing.pick = lambda docs, **columns: Source()
run = packing.token_pieces(None, sys.argv[1], digests=True)
packing.load(sys.argv[1])
begin, rows = memory("VmRSS"), 0
for out in run(batches()):
    rows += out.num_rows
print(rows, memory("VmHWM") - begin, memory("VmRSS") - begin)
"""
    done = subprocess.run([sys.executable, "-c", program, WORD], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    rows, most, left = map(float, done.stdout.split())
    assert rows >= 2000 and most < 160 and left < 70


def test_bpe_of_odd_rows(odd, empty):
    tokens = bpe.decode(bpe.encode(odd, BYTE), BYTE).collect()
    library = Tokenizer.from_file(BYTE)
    assert sorted((r.doc_id or -1, r.decoded, tuple(r.ids)) for r in tokens) == sorted(
        (i or -1, t or "", tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS
    )
    assert bpe.decode(bpe.encode(empty, BYTE), BYTE).count() == 0


def test_digests_are_those_of_ids(odd):
    """What the queries return without moving ids equals digests of the ids and texts themselves."""
    ids = packing.token_pieces(odd, WORD).select("doc_id", "piece", F.crc32("ids").alias("crc")).collect()
    assert sorted((r.doc_id or -1, r.piece, r.crc) for r in ids) == sorted((r.doc_id or -1, r.piece, r.ids_crc32) for r in packing.token_pieces(odd, WORD, digests=True).collect())
    library = Tokenizer.from_file(BYTE)
    want = []
    for i, text in TEXTS:
        found = library.encode(text or "", add_special_tokens=False).ids
        want.append((i or -1, len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(), hashlib.sha256(library.decode(found, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd, BYTE).collect()) == sorted(want)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule, draw):
    lengths = np.array([draw.choice((1, 5, 90, 700, 4096, draw.randrange(1, 4097))) for _ in range(1500)])
    for limits in ((4096, 4096, 4096.0**2), (4096, 3, 9e6)):
        bins, offsets = packing.best_fit(lengths, limits, rule=rule)
        for b in np.unique(bins):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1]]
            alone = len(own) == 1
            assert lengths[own].sum() <= limits[0] and len(own) <= limits[1] and (alone or (lengths[own].astype(float) ** 2).sum() <= limits[2])
    bins, _ = packing.best_fit(lengths, (4096, 4096, 4096.0**2))
    assert len(np.unique(bins)) <= -(-lengths.sum() // 4096) * 1.02 + 1


def test_packing_of_odd_rows(odd, empty):
    pieces = packing.token_pieces(odd, WORD)
    rows = packing.pack(pieces).collect()
    library = Tokenizer.from_file(WORD)
    want = sorted((i or -1, *library.encode(t or "", add_special_tokens=False).ids, 1) for i, t in TEXTS)
    parts: dict = {}
    for r in rows:
        parts.setdefault((r.doc_id or -1, r.piece), []).append(r)
        assert r.start == 4096 * r.piece and r.length == len(r.ids) // 4 <= 4096
    long = b"".join(bytes(parts[5, i][0].ids) for i in range(sum(1 for k in parts if k[0] == 5)))
    assert (5, *np.frombuffer(long, "<u4").tolist()) in want
    short = [(k[0], *np.frombuffer(r.ids, "<u4").tolist()) for k, v in parts.items() if k[0] != 5 for r in v]
    assert sorted(short) == [w for w in want if w[0] != 5]
    ends: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) == -(-sum(r.length for r in rows) // 4096)
    assert packing.pack(packing.token_pieces(empty, WORD)).count() == 0


def test_archives_round_trip(spark, tmp_path):
    big = "é" * 300_000
    pages = [(1, "http://a/ b\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", big), (6, "u", big), (None, "u", "<p>x</p>"), (None, "u", "only null"), (7, "u", "a\r\n\r\nb")]
    df = spark.createDataFrame([(*p, 1, "f") for p in pages], "page_id long, url string, html string, offset int, file string")
    index = write_archives(df, f"file://{tmp_path}/warc", archive_bytes=2000)
    assert index.select("file").distinct().count() > 1
    rows = read_records(index).collect()
    top: dict = {}
    for i, _, html in pages:
        top[html or ""] = max(i or -1, top.get(html or "", -1))
    want = []
    for i, _, html in pages:
        body, first = (html or "").encode(), top[html or ""]
        original = first == -1 or first == (i or -1)
        want.append((i or -1, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if original else "revisit", None if original else first, body if original else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in rows)
    some = index.where("page_id IN (1, 7)")
    assert sorted(r.page_id for r in read_records(some, gap_bytes=0).collect()) == [1, 7]
    assert {r.record_type for r in write_archives(df, f"file://{tmp_path}/other", least_bytes=10**7).collect()} == {"response"}
    assert read_records(write_archives(df.limit(0), f"file://{tmp_path}/none")).count() == 0


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def test_pseudonyms(spark, odd, empty):
    valid = {
        "4111 1111 1111 1111": r"\d{4} \d{4} \d{4} \d{4}", "4111111111111111": r"\d{16}", "DE89 3704 0044 0532 0130 00": r"DE\d\d( \d{4}){4} \d\d", "219-09-9999": r"\d{3}-\d\d-\d{4}",
        "97.51.17.173": r"\d+\.\d+\.\d+\.\d+", "2024-02-29": r"\d{4}-\d\d-\d\d", "31/12/1999": r"\d\d/\d\d/\d{4}", "+1 (017) 555-7713": r"\+1 \(\d{3}\) \d{3}-\d{4}", "ab.72@mail3.example.com": r"[a-z]{2}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com",
    }
    invalid = ["4111111111111112", "DE89370400440532013001", "666-09-9999", "997.51.17.173", "2023-02-29", "31/13/1999", "1.2.3", "12", "a@b"]
    texts = [f"See {v}, and {v}!! End" for v in valid] + [f"See {v}, end" for v in invalid]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonymised(df, "k1").collect()}
    new = []
    for i, (value, layout) in enumerate(valid.items()):
        m = re.fullmatch(rf"See ({layout}), and ({layout})!! End", got[i].text)
        assert m and m[1] != value and got[i].n_replaced == 2, got[i].text
        new.append(m[1])
        assert got[i].text.count(m[1]) == 2
    assert new[0].replace(" ", "") == new[1] and luhn(new[1])
    assert int("".join(str(int(c, 36)) for c in (new[2].replace(" ", "")[4:] + new[2][:4]))) % 97 == 1
    assert [got[len(valid) + i].text for i in range(len(invalid))] == [f"See {v}, end" for v in invalid]
    other = {r.doc_id: r.text for r in pseudonymised(df, "k2").collect()}
    assert all(other[i] != got[i].text for i in range(len(valid)))
    cards = spark.range(100).select(F.col("id").alias("doc_id"), F.format_string("219-09-%04d", F.col("id") + 1).alias("text"))
    assert pseudonymised(cards, "k1").select("text").distinct().count() == 100
    same = pseudonymised(odd, "k1")
    assert sorted(map(str, same.select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))
    assert set(same.columns) == {*odd.columns, "n_replaced"} and pseudonymised(empty, "k1").count() == 0


def test_licences(spark, odd, empty):
    wrapped = SENTENCES["mit-1"].replace(" ", "\n", 7)
    texts = {
        1: f"Intro.\n{wrapped}\n{SENTENCES['mit-2']} {SENTENCES['warranty-1']}", 2: f"{SENTENCES['mit-2']} {SENTENCES['mit-1']} {SENTENCES['warranty-1']}",
        3: " ".join(SENTENCES[f"bsd-{i}"] for i in (1, 2, 3)), 4: " ".join(SENTENCES[f"bsd-{i}"] for i in (1, 2, 3, 4)), 5: "x y z\nReleased under the MIT License.\nAll rights reserved.", 6: "A licence of mine.",
    }
    got = {r.doc_id: r.licenses for r in scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "", 3: "BSD-2-Clause", 4: "BSD-3-Clause", 5: "All-Rights-Reserved,MIT", 6: ""}
    assert {(r.sentences, r.licenses) for r in scan(odd).collect()} == {("", "")} and scan(odd).count() == len(TEXTS) and scan(empty).count() == 0


def test_phone_layouts(spark):
    found = [
        "+33 1 23 45 67 89", "+33 6 12 34 56 78", "+33 (0)1 23 45 67 89", "+33\u00a06\u00a012\u00a034\u00a056\u00a078", "+34 912 34 56 78", "+34 91 234 56 78", "+49 89 636 48018", "+49 (0)89 636-48018",
        "+49 30 123456 78", "+41 44 668 18 00", "+91 98765 43210", "+44 20 7946 0958", "+1 (017) 555-7713", "555 123 4567", "555-123-4567", "(555) 123-4567", "06 12 34 56 78", "01.23.45.67.89",
        "612 34 56 78", "91 234 56 78", "0171 1234567", "089 636 48018", "030/1234567",
    ]
    stays = ["+12 345", "+1234567890123456", "1 234 567", "2.555.123.4567", "12 34 56 78", "0.123456"]
    texts = [f"Call {v}. Or {v}, 2024 times" for v in found] + [f"Call {v}, x" for v in stays] + ["+33 1 23 45 67 89 2024 x"]
    got = {r.doc_id: r for r in pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k1").collect()}
    for i, value in enumerate(found):
        layout = re.sub(r"\d", r"\\d", re.escape(value))
        code = re.match(r"\+\d+", value)
        m = re.fullmatch(rf"Call ({layout})\. Or ({layout}), 2024 times", got[i].text)
        assert m and m[1] == m[2] != value and got[i].n_replaced == 2 and (not code or m[1].startswith(code[0])), (value, got[i].text)
    assert [got[len(found) + i].text for i in range(len(stays))] == texts[len(found) : -1]
    assert re.fullmatch(r"\+33 \d( \d\d){4} 2024 x", got[len(texts) - 1].text) and got[len(texts) - 1].n_replaced == 1


def test_a_phone_number_has_one_pseudonym_in_every_layout(spark):
    layouts = ["+33612345678", "+33 6 12 34 56 78", "+33.6.12.34.56.78", "+17005550123", "+1 (700) 555-0123", "+4989636480180", "+49 89 6364 80180", "+351912345678", "+351 912 345 678"]
    rows = pseudonymised(spark.createDataFrame(list(enumerate(layouts)), "doc_id long, text string"), "k1").collect()
    got = [re.sub(r"[^0-9]", "", r.text) for r in sorted(rows)]
    assert got[0] == got[1] == got[2] and got[3] == got[4] and got[5] == got[6] and got[7] == got[8]
    assert [g[: len(c)] for g, c in zip(got, "33 33 33 1 1 49 49 351 351".split(), strict=True)] == "33 33 33 1 1 49 49 351 351".split()
    assert all(g != re.sub(r"[^0-9]", "", t) for g, t in zip(got, layouts, strict=True))


def plain_feistel(values, ranges, key, kind):
    """The network by hand: halves take turns in shifting each other by digits of a digest."""
    half = len(values) // 2
    a, b, limits = list(values[:half]), list(values[half:]), (ranges[:half], ranges[half:])
    for turn in range(1, 9):
        other, part, limit = (b, a, limits[0]) if turn % 2 else (a, b, limits[1])
        digest = hashlib.sha512(",".join([f"{key}/{kind}", str(turn), *map(str, other)]).encode()).hexdigest()
        part[:] = [(v + int(digest[i % 25 * 5 : i % 25 * 5 + 5], 16)) % n for i, (v, n) in enumerate(zip(part, limit, strict=True))]
    return a + b


def test_feistel_equals_plain_python(spark, draw):
    rows = []
    for _ in range(60):
        ranges = [draw.choice((10, 26, 256, 1, 9999)) for _ in range(draw.randrange(2, 40))]
        rows.append(([draw.randrange(n) for n in ranges], ranges))
    df = spark.createDataFrame(rows, "v array<int>, r array<int>")
    for r in df.select("v", "r", feistel(F.col("v"), F.col("r"), "secret", "card").alias("to")).collect():
        assert r.to == plain_feistel(r.v, r.r, "secret", "card")


def test_long_runs_of_every_layout_end(spark):
    def runs(n):
        return ["x@" + "a." * n + "com", "x@" + "a-" * n + ".com", "@" * n, "a@b." * n, "1" * n, "1 " * n, "1-" * n, "1." * n, "12/" * n, "+1 " * n, "+" * n, "(" * n, "1234 " * n, "GB12 " + "ABCD " * n, "A" * n, "0-0" * n,
            "x" * n + "@a.com", "1.2.3.4." * n, "12 34 " * n, "+33 " + "1 " * n, "555-" * n, "06 " * n]

    table = lambda n: spark.createDataFrame(list(enumerate(runs(n))), "doc_id long, text string").repartition(8)
    found = table(100_000).select(F.size(F.regexp_extract_all("text", F.lit(PATTERN), 0)).alias("n")).collect()
    got = pseudonymised(table(3_000), "k1").collect()
    assert len(found) == len(got) == len(runs(1))
    long = pseudonymised(spark.createDataFrame([("b@" + "a-" * 100_000 + ".com",)], "text string").repartition(2), "k1").first().text
    assert len(long) == 200_006 and long.endswith(".com") and long[:20] != "b@a-a-a-a-a-a-a-a-a-"


def test_the_key_is_the_sessions(spark):
    spark.conf.unset(KEY_SETTING)
    drawn = session_key(spark)
    assert len(drawn) == 64 and session_key(spark) == drawn
    spark.conf.set(KEY_SETTING, "mine")
    assert session_key(spark) == "mine"
    spark.conf.unset(KEY_SETTING)


NOTICES = {
    "MIT": """MIT License

Copyright (c) 2024 X

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
""",
    "ISC": """ISC License

Copyright (c) 2024 X

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.
""",
    "Apache-2.0": """   Copyright 2024 X

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
""",
}


def test_original_notices_with_their_line_breaks(spark):
    forms = {"plain": lambda t: t, "dos": lambda t: t.replace("\n", "\r\n"), "comment": lambda t: "".join(f" * {line}\n" for line in t.split("\n")), "doubled": lambda t: t.replace("\n", "\n\n")}
    rows = [(f"{name}/{form}", f"A title\n{change(text)}") for name, text in NOTICES.items() for form, change in forms.items()]
    rows.append(("Apache-2.0/ref", "Title\nLicensed under the Apache License, Version 2.0\n(the \"License\");"))
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {i: r.licenses for i, r in got.items()} == {i: i.split("/")[0] for i, _ in rows}
    assert got["MIT/plain"].sentences == "mit-1,mit-2,warranty-1" and got["Apache-2.0/ref"].sentences == "apache-ref,apache-1"


def test_every_part_passes_the_prefilter(spark):
    import duckdb

    from sluicebox.llm.queries import SQL

    assert [p for p in PARTS if not re.search(MAY, p)] == []
    rows = [(i, t) for i, t in enumerate([*PARTS, "2.0", "Release notes.\n2.0\nNew: x", "see 12.05"])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.sentences, r.licenses) for r in got) == sorted(con.execute(SQL["op10_licenses"]).fetchall())


def wrapped(*names, width=60, mark=""):
    """Sentences as a notice prints them: joined, and broken into lines."""
    return "\n".join(mark + line for line in textwrap.wrap(" ".join(SENTENCES[n] for n in names), width))


def clause(holder, ending="nor the names of its contributors may"):
    return f"Neither the name of {holder} {ending} be used to endorse or promote products derived from this software without specific prior written permission."


def test_notices_with_line_breaks_equal_sql(spark):
    import duckdb

    from sluicebox.llm.queries import SQL

    head, mit, bsd2 = "Copyright (c) 2024 Jane Roe\n\n", wrapped("mit-1", "mit-2", "warranty-1"), wrapped("bsd-1", "bsd-2", "bsd-3")
    listed = "\n".join(f"{i}. {wrapped(n, width=50)}" for i, n in enumerate(["bsd-2", "bsd-3"], 1))
    notices = [
        ("MIT License\n\n" + head + mit, "MIT"),
        ("The MIT License (MIT)\n" + head + mit.replace("\n", "\n\n"), "MIT"),
        (head + "All rights\nreserved.\n" + mit, "All-Rights-Reserved,MIT"),
        (wrapped("mit-1", "mit-2", "warranty-1", mark=" * "), "MIT"),
        (head + bsd2, "BSD-2-Clause"),
        (head + bsd2 + "\n" + wrapped("bsd-4"), "BSD-3-Clause"),
        (head + bsd2 + "\n\n3. " + "\n".join(textwrap.wrap(clause("Jane Roe"), 60)), "BSD-3-Clause"),
        (head + bsd2 + "\n\n* " + clause("the University of Somewhere"), "BSD-3-Clause"),
        (head + bsd2 + "\n" + clause("Roe, Doe & Sons, Inc."), "BSD-3-Clause"),
        (head + bsd2 + "\n3. " + clause("X").replace("Neither the name of X nor the names of its contributors may", "The name of the author may not"), "BSD-3-Clause"),
        (head + wrapped("bsd-1") + "\n" + listed + "\n3. " + clause("Jane Roe", "nor the names of its\ncontributors may"), "BSD-3-Clause"),
        (head + wrapped("bsd-1") + "\n" + listed, "BSD-2-Clause"),
        ("A title\n" + wrapped("apache-1", "apache-2", "apache-3", width=70) + "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + wrapped("apache-4", "apache-5", width=70), "Apache-2.0"),
        (wrapped("gpl-1-v2", "gpl-2", "gpl-3", mark="# "), "GPL-2.0-or-later"),
        (wrapped("gpl-1-v3", width=40) + "\n\n" + wrapped("gpl-2", "gpl-3", width=40), "GPL-3.0-or-later"),
        ("ISC License\n" + head + wrapped("isc-1"), "ISC"),
        ("// SPDX-License-Identifier: MIT\nint main;", "MIT"),
        ("# spdx-license-identifier:GPL-2.0-only", "GPL-2.0"),
        ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"),
        ("SPDX-License-Identifier: GPL-3.0-or-later.", "GPL-3.0-or-later"),
        ("SPDX-License-Identifier: Unknown-1.0", ""),
        ("The name of the game is to promote products.", ""),
    ]
    rows = [(i, t) for i, (t, _) in enumerate(notices)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = {r.doc_id: (r.sentences, r.licenses) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(notices[i][0], got[i][1]) for i in sorted(got)] == notices
    assert {i: (s, names) for i, s, names in con.execute(SQL["op10_licenses"]).fetchall()} == got


@pytest.mark.parametrize("name", ["op5_warc", "op10_licenses"])
def test_query_equals_sql(spark, name):
    from .sql import compare

    compare(spark, name)


def test_query_digests_are_of_the_ids(spark):
    from .sql import SF
    from sluicebox.llm.queries import QUERIES

    library = Tokenizer.from_file(WORD)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op2_packing"](spark, SF).collect():
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1][r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
    library = Tokenizer.from_file(BYTE)
    for r in QUERIES["op4_bpe"](spark, SF).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
