"""Chat formatting, rules, licences, encoding, language model, decontamination and counts against brute force."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewright.llm import blocks, bpe, chat, decontaminate, lattice, licenses, quality_rules, queries, token_counts
from tidewright.llm.frames import fold

from ..conftest import SF

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, "Hello world, it's   5 o'clock!\n\n  x"), (2, ""), (3, None), (None, "null id"), (5, "é ü 漢字 😀 <|endoftext|>"), (5, "repeated id"), (6, "z" * 5000), (7, " \t\n "), (8, "word " * 3000), (9, "Hello world, it's   5 o'clock!\n\n  x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in ODD], "doc_id long, text string, token_ids string").repartition(3)


def binomial_tail(n, k, p):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))


def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library_and_decoding_gives_the_text_back(spark, odd):
    out = bpe.decode(bpe.encode(odd, vocabulary=RANKS, pattern=public_tokenizers.PATTERN), vocabulary=RANKS).collect()
    own, want = encoder(), sorted((str(i), encoder().encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD)
    assert own and sorted((str(r.doc_id), r.token_ids, bytes(r.decoded)) for r in out) == want
    assert bpe.encode(odd.limit(0), vocabulary=RANKS, pattern=public_tokenizers.PATTERN).count() == 0


def test_ids_are_decoded_where_they_are_put_in_place(spark, odd):
    options = {"vocabulary": RANKS, "pattern": public_tokenizers.PATTERN}
    ours = bpe.encode(odd, **options, decoded=True).collect()
    apart = bpe.decode(bpe.encode(odd, **options), vocabulary=RANKS).collect()
    assert sorted(ours, key=str) == sorted(apart, key=str)
    assert bpe.encode(odd.limit(0), **options, decoded=True).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = corpus_pipeline.encode(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and plan.count("MapInArrow") == 2  # words and positions; each task has one Python worker


def test_small_blocks_agree_with_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("weight"))

    def tokenise(column):
        from tidewright.llm import bytewords

        for row, end, data, offsets in bytewords.text_slices(column, 1 << 12):
            words = bytewords.words(data, offsets)
            yield row, end, blocks.word_array(words), np.diff(words.first)

    def finish(ids, weights, sizes, at, answers):
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        return pa.table({"doc_id": ids, "s": [int(answers["count"].to_numpy()[at[a:b]].sum()) if b > a else 0 for a, b in zip(cuts, cuts[1:])]})

    def sums(size, ranges=1):
        packed = blocks.blocks(docs, tokenise, 5, block_bytes=size)
        words = packed.filter(F.col("part") < blocks.POSITIONS)
        shape = blocks.Layout(5, ranges)
        return sorted(blocks.by_block(blocks.by_shard(words, lambda w, c: {"count": pa.array(c)}, shape), packed.filter(F.col("part") >= blocks.POSITIONS), finish, "doc_id long, s long").collect())

    counts = Counter(w for r in docs.collect() for w in r.text.encode().lower().split())
    want = sorted((r.doc_id, sum(counts[w] for w in r.text.encode().lower().split())) for r in docs.collect())
    assert [tuple(x) for x in sums(1 << 14)] == want == [tuple(x) for x in sums(1 << 30)] == [tuple(x) for x in sums(1 << 14, 3)]


def test_an_id_outside_the_vocabulary_stops_decoding(spark):
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [50256])], "doc_id long, token_ids array<int>"), vocabulary=RANKS).collect()


def lattice_sum(word: bytes, scores, texts) -> float:
    """All segmentations, by recursion in plain probabilities."""
    best = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        best[end] = best[end - 1] * math.exp(scores[len(scores) - 256 + word[end - 1]])
        for start in range(end):
            if word[start:end] in texts:
                best[end] += best[start] * math.exp(scores[texts[word[start:end]]])
    return math.log(best[-1])


def test_lattice_sums_all_segmentations():
    known = lattice.pieces(PIECES)
    scores = lattice.starting_scores(known)
    assert np.exp(scores).sum() == pytest.approx(1.0)
    words = [b"the", b"internationalisation", "çré".encode(), b"q", b"\x00\xff", b"a" * 60]
    got = lattice.word_scores(pa.array(words, pa.large_binary()), scores, known)
    for word, value in zip(words, got):
        assert value == pytest.approx(lattice_sum(lattice.MARK + word, scores, known.texts), rel=1e-9)
    long = b"the" * 200
    assert lattice.word_scores(pa.array([long], pa.large_binary()), scores, known)[0] == pytest.approx(lattice._forward_scalar(lattice.MARK + long, scores, known))


def test_expected_uses_add_up():
    known = lattice.pieces(PIECES)
    scores = lattice.starting_scores(known)
    words, counts = pa.array([b"the", b"thing"], pa.large_binary()), np.array([3, 2])
    uses = lattice.expected_uses(words, counts, scores, known)
    sizes = np.zeros(known.size)
    for text, i in known.texts.items():
        sizes[i] = len(text)
    sizes[-256:] = 1
    assert uses @ sizes == pytest.approx(3 * (3 + 3) + 2 * (5 + 3))  # every byte is in exactly one piece


def test_long_words_have_the_expected_uses_of_the_lattice(monkeypatch):
    known = lattice.pieces(PIECES)
    scores = lattice.starting_scores(known)
    texts = [b"internationalisation" * 15, "検索語と文章の長さを数える".encode() * 9, bytes(range(33, 256)) * 2, b"a" * 700, b"https://www.example.org/the/of?q=" + b"aGVsbG8gd29ybGQ" * 30]
    words, counts = pa.array(texts, pa.large_binary()), np.array([1, 2, 1, 3, 5])
    with monkeypatch.context() as all_in_one:
        all_in_one.setattr(lattice, "WIDE", 10**6)
        want = lattice.expected_uses(words, counts, scores, known)
    for stretch in (4096, 50, 7, 1):
        monkeypatch.setattr(lattice, "STRETCH", stretch)
        assert np.allclose(lattice.expected_uses(words, counts, scores, known), want, rtol=1e-8, atol=1e-10)


def test_language_model_counts_and_improves_with_training(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, "")], "doc_id long, text string"))
    out = {r.doc_id: r for r in lattice.score(docs, fold(F.col("doc_id"), 7) == 2, vocabulary=PIECES).collect()}
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(t for i, w in texts.items() if i not in held for t in [*w, None])
    n, v = sum(c.values()), len(c)
    for i, w in texts.items():
        tokens, r = [*w, None], out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens))
        assert math.isfinite(r.score) and r.score < 0
    assert lattice.score(docs.limit(0), F.lit(False), vocabulary=PIECES).count() == 0


def test_language_model_scores_equal_a_plain_model(spark):
    """The whole score by dictionaries: expectation maximisation over lattices of all words, discounts and sums."""
    rng = random.Random(12)
    syllables = ["the", "ing", "and", "st", "o", "er", "é", "x", "qu"]
    words = ["".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 25)))) for i in range(60)] + [(100, None), (101, "the" * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = lattice.pieces(PIECES)
    texts = {i: (t or "").encode().lower().split() for i, t in rows}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, ws in texts.items() if i not in held for w in ws)
    scores = lattice.starting_scores(known)
    starting = np.exp(scores)

    def edges(word):
        """(start, end, piece) of all pieces in the word and its mark."""
        raw = lattice.MARK + word
        for end in range(1, len(raw) + 1):
            for start in range(max(0, end - known.longest), end):
                if raw[start:end] in known.texts:
                    yield start, end, known.texts[raw[start:end]]
            yield end - 1, end, known.size - 256 + raw[end - 1]

    def forward(word, chances):
        alpha = [1.0] + [0.0] * len(lattice.MARK + word)
        for start, end, piece in edges(word):
            alpha[end] += alpha[start] * chances[piece]
        return alpha

    for _ in range(2):
        chances, uses = np.exp(scores), np.zeros(known.size)
        for word in counts:
            alpha, found = forward(word, chances), list(edges(word))
            beta = [0.0] * (len(alpha) - 1) + [1.0]
            for start, end, piece in sorted(found, key=lambda e: -e[0]):
                beta[start] += chances[piece] * beta[end]
            for start, end, piece in found:
                uses[piece] += alpha[start] * chances[piece] * beta[end] / alpha[-1]
        scores = np.log((uses + 1000.0 * starting) / (uses.sum() + 1000.0))
    ends, once, twice = len(texts) - len(held), sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    total = sum(counts.values()) + ends
    discount = once / (once + 2 * twice) if twice else 0.5
    escape = max(discount * len(counts), 1.0) / total
    chances = np.exp(scores)
    spelled = {w: forward(w, chances)[-1] for ws in texts.values() for w in ws}
    end = math.log10((ends + 1) / (total + 1))
    for shape in (None, blocks.Layout(3, 2)):
        got = {r.doc_id: r for r in lattice.score(docs, fold(F.col("doc_id"), 7) == 2, vocabulary=PIECES, layout=shape).collect()}
        for i, ws in texts.items():
            assert got[i].lattice_score == pytest.approx(end + sum(math.log10(spelled[w]) for w in ws), abs=1e-3)
            assert got[i].score == pytest.approx(end + sum(math.log10(max(counts[w] - discount, 0) / total + escape * spelled[w]) for w in ws), abs=1e-3)


def test_layouts_grow_with_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame([("x" * 100,)] * 50, "text string")
    assert blocks.layout(docs) == blocks.Layout(1, 1) == blocks.layout(docs.limit(0))
    monkeypatch.setattr(blocks, "SHARD_BYTES", 1000)
    monkeypatch.setattr(blocks, "RANGE_BYTES", 2000)
    assert blocks.layout(docs) == blocks.Layout(5, 3)
    rows = [(i, t) for i, t in ODD if i is not None]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i, encoder().encode_ordinary(t or "")) for i, t in rows)
    out = bpe.encode(odd, vocabulary=RANKS, pattern=public_tokenizers.PATTERN).collect()  # some shards, several ranges
    assert sorted((r.doc_id, r.token_ids) for r in out) == want


def test_chats_read_back(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "user", "<|im_end|>\n<|im_start|>assistant\nno"), (1, 2, "assistant", "%3C|im_next|>%25"), (1, 2, "assistant", "%3C|im_next|>%25"), (1, 3, None, None), (2, 0, "as\nsis<|tant", "x"), (None, None, "assistant", ""), (3, 5, "assistant", "b"), (3, 4, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in chat.format_chats(df).select("conv_id", "messages", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.learned(F.col("segments")).alias("learned"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("joined")).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("user", rows[0][3]), ("user", rows[1][3]), ("assistant", rows[2][3]), ("assistant", rows[2][3]), ("", "")]
    assert [(m.role, len(m.texts)) for m in out[1].messages] == [("user", 2), ("assistant", 2), ("", 1)]
    assert out[1].learned == rows[2][3] * 2 and out[3].learned == "ab" and out[None].learned == ""
    assert [(t.role, t.text) for t in out[2].turns] == [("as\nsis<|tant", "x")]
    assert all(r.joined == r.formatted for r in out.values())
    assert "</s>" not in out[1].formatted and out[1].formatted.count("<|im_end|>") == 3
    assert chat.format_chats(df.limit(0)).count() == 0


def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    import glob
    import os

    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name, sql in queries.ORACLE_SQL.items():
        ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.sql(sql).df()
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        assert sorted(map(tuple, ours[columns].values.tolist())) == sorted(map(tuple, theirs[columns].values.tolist())), name


def py_repeat(text):
    w = (text or "").encode().split()
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    again = Counter(windows)
    return len({p for i, x in enumerate(windows) if again[x] > 1 for p in range(i, i + 8)})


def test_rule_signals_of_odd_texts(spark):
    rng = random.Random(4)
    texts = ["", None, " \n\t", "a b", "x y z " * 10, "l1\nl1\n\n \nl2\nl1", "#*$%&|<> é漢", "one " * 7, "one " * 8, "one " * 9, " ".join(rng.choices("abc", k=300)), "ABC def\x0bghi j"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    out = {r.doc_id: r for r in quality_rules.signals(df).collect()}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), py_repeat(t)), (i, t)


def test_binomial_bounds_are_exact(spark):
    cases = [(10, 0), (1000, 1), (5000, 10), (200_000, 900)]
    got = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.lower_tail(F.col("n"), F.col("k"), 0.005).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(binomial_tail(r.n, r.k, 0.005), rel=1e-6)


def test_rules_control_their_risk(spark):
    """Good texts share a signal with bad ones; in each stratum no more than alpha of fresh good texts is lost."""
    rng = random.Random(9)

    def text(good):
        symbols = rng.random() * (0.05 if good and rng.random() < 0.97 else 0.5)
        return " ".join("w%d%s" % (rng.randrange(10**6), "#" * (rng.random() < symbols * 6)) for _ in range(40))

    rows = [(i, text(i % 5 != 0), "en" if i % 3 else "de", int(i % 5 != 0)) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    labels = df.filter("doc_id < 6000").select("doc_id", "quality")
    out = quality_rules.judge(df, labels, alpha=0.2).join(df.select("doc_id", "lang", "quality"), "doc_id").filter("doc_id >= 6000").toPandas()
    lost = 1 - out[out.quality == 1].groupby("lang").kept.mean()
    assert (lost < 0.2).all() and out[out.quality == 0].kept.mean() < 0.9
    assert quality_rules.judge(df.limit(0), labels).count() == 0
    assert quality_rules.judge(df.limit(50), labels.limit(0)).filter("not base_failed and not kept").count() == 0
    assert quality_rules.keep(df.limit(50), labels).columns == df.columns


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
Some words between. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_licences_in_order(spark):
    rows = [(1, MIT), (2, "x.\nReleased under the MIT License.\nReleased under the MIT License."), (3, "Licensed under the Apache License"), (4, None), (5, ""), (None, "Licensed under CC BY-NC 4.0."), (6, "\n".join(reversed(MIT.split("\n\n"))))]
    out = sorted((str(r.doc_id), r.license, r.sentences) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [("1", "MIT", "3,4,5,6"), ("2", "MIT", "1,1"), ("None", "CC-BY-NC-4.0", "30")]


GPL = """This program is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version {version} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""


def test_published_headers_meet_their_rules(spark):
    texts = {"GPL-3.0": GPL.format(mark=":", version=3), "GPL-2.0": GPL.format(mark=";", version=2), "Apache-2.0": APACHE, "MPL-2.0": MPL}
    shapes = [str, lambda t: "".join(f"# {x}".rstrip() + "\n" for x in t.splitlines()), lambda t: t.replace("\n", "\r\n")]
    rows = [(i, shape(text)) for i, text in enumerate(texts.values()) for shape in shapes]
    out = sorted((r.doc_id, r.license, r.sentences) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    sentences = ("21,23,24", "22,23,24", "11,12,13,14,15", "60")
    assert out == [(i, name, found) for i, (name, found) in enumerate(zip(texts, sentences)) for _ in shapes]


LESSER = GPL.replace("This program", "This library").replace("GNU General", "GNU Lesser General")
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MORE = {
    ("LGPL-2.1", "26,29,36"): LESSER.format(mark=";", version="2.1"),
    ("LGPL-3.0", "27,29,36"): LESSER.format(mark=";", version=3),
    ("AGPL-3.0", "28,23,37"): GPL.format(mark=":", version=3).replace("GNU General", "GNU Affero General").replace("Foundation;", "Foundation,"),
    ("BSD-2-Clause", "40,41,42,44"): BSD.format(third=""),
    ("BSD-3-Clause", "40,41,42,43,44"): BSD.format(third=THIRD),
    ("0BSD", "51"): "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n",
    ("EPL-2.0", "61"): "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n\nSPDX-License-Identifier: EPL-2.0\n",
    ("Zlib", "80,81,82"): "This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. x",
    ("CC0-1.0", "71,72"): "To the extent possible under law, the author(s) have dedicated all\ncopyright and related and neighboring rights to this software to the\npublic domain worldwide. This software is distributed without any warranty.\n\nYou should have received a copy of the CC0 Public Domain Dedication along\nwith this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.",
    ("OFL-1.1", "64"): "This Font Software is licensed under the SIL Open Font License, Version 1.1.\n",
}


def test_the_longest_rule_speaks(spark):
    rows = list(enumerate(MORE.values()))
    out = sorted((r.doc_id, r.license, r.sentences) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(i, *found) for i, found in enumerate(MORE)]
    assert licenses.covers(licenses.RULES)["bsd-2-clause"] == ["bsd-2-clause-text", "bsd-3-clause", "bsd-3-clause-text"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows + [(100, APACHE), (101, GPL.format(mark=":", version=3)), (102, MPL), (103, None)])
    by_sql = con.sql(licenses.oracle_sql()).fetchall()
    assert sorted((i, name, found) for i, _, name, found in by_sql if i < 100) == out
    assert sorted((i, found) for i, _, _, found in by_sql if i >= 100) == [(100, "11,12,13,14,15"), (101, "21,23,24"), (102, "60")]


def test_licences_of_odd_rows(spark):
    long = "plain words that say nothing. " * 30_000 + "\nReleased under the MIT License.\n"
    rows = [(1, long), (2, long), (2, long), (3, "\n" * 1000), (4, "licence " * 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rule", F.lit("clash")).withColumn("found", F.lit(1))
    out = licenses.scan(df)
    assert out.columns == ["doc_id", "rule", "license", "sentences"]
    assert sorted(map(tuple, out.collect())) == [(i, "mit-notice", "MIT", "1") for i in (1, 2, 2)]
    assert licenses.scan(df.limit(0)).count() == 0


def test_bm25_equals_an_exhaustive_scorer(spark):
    """All pairs of passage and segment scored in plain Python, ties included; verified as the operator says."""
    rng = random.Random(31)
    words = ["q%d" % min(int(rng.expovariate(0.02)), 400) for _ in range(5000)]
    say = lambda n: rng.choices(words, k=n)
    items = [(i, " ".join(say(rng.choice([6, 25, 60, 150]))), " ".join(say(rng.randrange(0, 9))) or None) for i in range(50)]
    items += [(60, *items[3][1:]), (61, "twin of nothing", None), (3, "another text of the third item " + " ".join(say(20)), None)]
    docs = []
    for i in range(90):
        text = say(rng.randrange(0, 260))
        if i % 2 == 0:
            _, question, answer = rng.choice(items)
            part = f"{question} {answer or ''}".split()
            lost = rng.sample(range(len(part)), k=len(part) * (i % 3) // 14)
            text[len(text) // 2 : len(text) // 2] = [w for k, w in enumerate(part) if k not in lost]
        docs.append((i, " ".join(text)))
    segment, stride, threshold, width = 40, 24, 0.5, 3
    segments = []
    for k, (_, question, answer) in enumerate(items):
        whole = question.split() + (answer or "").split()
        segments += [(k, s.tolist()) for s in np.array_split(np.array(whole, object), -(-len(whole) // segment))]
    n, mean = len(segments), sum(len(s) for _, s in segments) / len(segments)
    df_of = Counter(t for _, s in segments for t in set(s))

    def impact(t, s):
        idf, tf = math.log1p((n - df_of[t] + 0.5) / (df_of[t] + 0.5)), s.count(t)
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(s) / mean))

    def shingles(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    def overlap(part, around):
        k = min(width, len(part))
        return 1.0 if not k else len(shingles(part, k) & shingles(around, k)) / len(shingles(part, k))

    want = {}
    weights = [{t: impact(t, s) for t in set(s)} for _, s in segments]
    for doc, text in docs:
        w = text.split()
        for start in range(0, max(1, len(w) - segment) if w else 0, stride):
            passage = set(w[start : start + segment + stride])
            for (k, _), weight in zip(segments, weights):
                score = sum(v for t, v in weight.items() if t in passage) / sum(weight.values())
                if score < threshold - 1e-9:
                    continue
                item, question, answer = items[k][0], items[k][1].split(), (items[k][2] or "").split()
                reach = len(question) + len(answer)
                around = w[max(0, start - reach) : min(len(w), start + segment + stride) + reach]
                shares = overlap(question, around), overlap(answer, around)
                if min(shares) >= 0.5 or overlap(question + answer, around) >= 0.8:
                    want[doc, item] = max(want.get((doc, item), 0.0), score)
    bench = spark.createDataFrame(items, "item_id long, question string, answer string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for options in ({}, {"index_bytes": 30_000}):
        parts = len(list(decontaminate._indexes(bench, segment, options.get("index_bytes", 64 << 20))))
        assert (parts > 1) == bool(options)
        got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(frame, bench, **options).collect()}
        assert got.keys() == want.keys() and len(want) > 15
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_decontamination_finds_what_brute_force_finds(spark):
    rng = random.Random(6)
    words = ["v%d" % i for i in range(4000)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, f"{say(n)}. {say(6)}.") for i, n in enumerate((8, 20, 45, 130, 400))] + [(90, None), (91, ""), (92, "single sentence without an end " + say(9)), *[(93, say(30) + ".\nYes.")] * 2]
    texts = {i: t for i, t in items if t}
    docs = [(i, say(200)) for i in range(40)]
    docs += [(100 + i, f"{say(rng.randrange(90))} {t.upper()} {say(50)}") for i, t in texts.items()]
    docs += [(300 + i, f"{say(30)} {' '.join(t.split()[: len(t.split()) // 5])} {say(30)}") for i, t in texts.items()]  # a fifth is not a copy
    docs += [(500, None), (501, ""), (None, texts[1]), (502, texts[0] + " " + texts[2]), (502, texts[0])]
    bench = decontaminate.questions(spark.createDataFrame(items, "item_id long, text string"))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1))
    for options in ({}, {"index_bytes": 20_000}):
        found = sorted((str(r.doc_id), r.item_id) for r in decontaminate.contaminated(df, bench, **options).collect())
        want = sorted([*((str(100 + i), i) for i in texts), ("None", 1), ("502", 0), ("502", 2), ("502", 0)])
        assert found == want
    kept = {r.doc_id for r in decontaminate.clean(df, bench).collect()}
    assert kept == {i for i, _ in docs} - {None, 502, *(100 + i for i in texts)}
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_block_max_bounds_lose_nothing(spark, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench = decontaminate.questions(items).withColumn("key", F.xxhash64("item_id", "question", "answer"))
    index = decontaminate.build(decontaminate.impacts(decontaminate.segment_terms(bench, 40)).toArrow(), bench.collect())
    rng = np.random.default_rng(1)
    start = index.posting_start[index.block_start]  # of each term
    for threshold in (0.05, 0.2, 0.6):
        for _ in range(50):
            terms = np.unique(rng.integers(0, len(index.terms), 40))
            scores = np.zeros(len(index.item_of))
            for t in terms:
                for p in range(start[t], start[t + 1]):
                    scores[index.segments[p]] += index.weights[p]
            found, values = decontaminate.retrieve(index, terms, threshold)
            assert found.tolist() == np.flatnonzero(scores >= threshold).tolist()
            assert values == pytest.approx(scores[found])
    # a passage that is one segment opens that segment's block and reads no other postings
    read = []
    gather = decontaminate._gather
    monkeypatch.setattr(decontaminate, "_gather", lambda s, which: read.append((s, gather(s, which))) or read[-1][1])
    for segment in range(len(index.item_of)):
        terms = np.flatnonzero([segment in index.segments[start[t] : start[t + 1]] for t in range(len(index.terms))])
        decontaminate.retrieve(index, terms, 0.9)
        opened = np.unique(index.segments[read[-1][1]] // decontaminate.BLOCK)
        assert read[-1][0] is index.posting_start and segment // decontaminate.BLOCK in opened
        assert len(read[-1][1]) < sum(start[t + 1] - start[t] for t in terms) or len(index.item_of) <= decontaminate.BLOCK


def test_token_counts_answer_every_limit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").unionByName(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string"))
    out = token_counts.token_counts(docs, vocabulary=RANKS, pattern=public_tokenizers.PATTERN).collect()
    lengths = {}
    for r in docs.collect():
        lengths.setdefault(r.lang or "", []).append(len(encoder().encode_ordinary(r.text or "")))
    assert {(r.group, r.context_limit) for r in out} == {(g, n) for g, xs in lengths.items() for n in xs}
    for r in out:
        xs, n = lengths[r.group], r.context_limit
        assert (r.n_docs, r.docs_over, r.tokens_over, r.total_docs, r.total_tokens, r.kept_tokens) == (xs.count(n), sum(x > n for x in xs), sum(x for x in xs if x > n), len(xs), sum(xs), sum(min(x, n) for x in xs))
        assert r.share_within == pytest.approx(sum(x <= n for x in xs) / len(xs))


def test_digests_of_the_bpe_query(spark):
    out = {r.doc_id: r for r in queries.QUERIES["op6_byte_bpe"](spark, SF).collect()}
    own = encoder()
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect():
        ids = own.encode_ordinary(r.text)
        assert (out[r.doc_id].n_tokens, out[r.doc_id].ids_sha256, out[r.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


FOURTH = """3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement: This product includes software developed by the Example Group.

4. Neither the name of the Example Group nor the
   names of its contributors may be used to endorse or promote products
   derived from this software without specific prior written permission.
"""
APACHE_TEXT = """                                 Apache License
                           Version 2.0, January 2004

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

      "Licensor" shall mean the copyright owner or entity authorized by
      the copyright owner that is granting the License.
"""
GPL3_TEXT = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
"""
GPL2_TEXT = """ Copyright (C) 1989, 1991 Free Software Foundation, Inc.,
 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The licenses for most software are designed to take away your
freedom to share and change it.  By contrast, the GNU General Public
License is intended to guarantee your freedom to share and change free
software--to make sure the software is free for all its users.  This
"""
MPL_TEXT = """1. Definitions
--------------

1.1. "Contributor"
    means each individual or legal entity that creates, contributes to
    the creation of, or owns Covered Software.

1.4. "Covered Software"
    means Source Code Form to which the initial Contributor has attached
    the notice in Exhibit A, the Executable Form of such Source Code
    Form, and Modifications of such Source Code Form, in each case
    including portions thereof.
"""
NAMED = [
    (["BSD-3-Clause"], BSD.format(third=THIRD.replace("the copyright holder", "Google Inc."))),
    (["BSD-3-Clause"], BSD.format(third=THIRD.replace("its", "any").replace("the copyright holder", "the University of Somewhere, its parts and friends,")).replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS")),
    (["BSD-3-Clause"], BSD.format(third="\n3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n")),
    (["BSD-3-Clause"], BSD.format(third=THIRD).replace("1. ", "(1) ").replace("2. ", "* ").replace("3. ", "c) ")),
    ([], BSD.format(third="\n3. Our name must never be used to endorse or promote products made with it.\n")),
    ([], BSD.format(third="\n3. You may not use this on Sundays without asking us for permission first.\n")),
    (["BSD-4-Clause"], BSD.format(third="\n" + FOURTH)),
    (["BSD-2-Clause"], BSD.format(third="")),
    (["MIT"], "The project is licensed under the MIT License.\n"),
    (["MIT"], "All of this code is released under the terms of the MIT license. Enjoy."),
    (["GPL-3.0"], "This work is licensed under the GNU General Public License, version 3."),
    (["MIT"], "// SPDX-License-Identifier: MIT\nint main() {}"),
    (["GPL-2.0"], "/* SPDX-License-Identifier: GPL-2.0-only */\ncode"),
    (["Apache-2.0"], "# SPDX-License-Identifier: Apache-2.0"),
    (["Apache-2.0"], APACHE + "\nSPDX-License-Identifier: Apache-2.0\n"),
    ([], "# SPDX-License-Identifier: MIT OR Apache-2.0"),
    ([], "Not every license is the MIT license, and the licence of this text is none of them."),
    (["Apache-2.0"], APACHE_TEXT), (["GPL-3.0"], GPL3_TEXT), (["GPL-2.0"], GPL2_TEXT), (["MPL-2.0"], MPL_TEXT), (["GPL-3.0"], GPL3_TEXT.replace("\n", "\r\n")),
]


def test_names_are_slots_and_no_shorter_rule_stands_for_a_longer_one(spark):
    rows = [(i, text) for i, (_, text) in enumerate(NAMED)]
    got = {i: [] for i, _ in rows}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append(r.license)
    assert got == {i: names for i, (names, _) in enumerate(NAMED)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    by_sql = sorted((i, name) for i, _, name, _ in con.sql(licenses.oracle_sql()).fetchall())
    assert by_sql == sorted((i, name) for i, names in got.items() for name in names)


def _by_spaces(column):
    from tidewright.llm import bytewords

    for row, end, data, offsets in bytewords.text_slices(column, 1 << 12):
        words = bytewords.words(data, offsets)
        yield row, end, blocks.word_array(words), np.diff(words.first)


def test_a_block_makes_few_rows_however_many_shards_there_are(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("weight"))
    shape = blocks.Layout(10_048, 3)
    rows = blocks.blocks(docs, _by_spaces, shape.bundles, block_bytes=1 << 15).groupBy("block").count()
    assert rows.count() > 5 and rows.agg(F.max("count")).first()[0] <= blocks.BUNDLES + 1
    with pytest.raises(ValueError):
        blocks.Layout(100)


def test_bundles_of_shards_give_the_same_answers(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BUNDLES", 4)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("weight")).unionByName(spark.createDataFrame([(-1, None, 1), (None, "", 1)], "doc_id long, text string, weight int"))

    def finish(ids, weights, sizes, at, answers):
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        sums = np.concatenate(([0], np.cumsum(answers["count"].to_numpy()[at] if len(at) else np.zeros(0, np.int64))))
        return pa.table({"doc_id": ids, "s": pa.array(np.diff(sums[cuts]))})

    def run(shape):
        packed = blocks.blocks(docs, _by_spaces, shape.bundles, block_bytes=1 << 15).persist()
        words, positions = packed.filter(F.col("part") < blocks.POSITIONS), packed.filter(F.col("part") >= blocks.POSITIONS)
        answer = lambda w, c: {"count": pa.array(c)}
        at_once = blocks.by_shard(words, answer, shape)
        kept = blocks.put(words, blocks.over_words(blocks.distinct(words, shape), answer), shape)
        told = [sorted(map(str, blocks.by_block(x, positions, finish, "doc_id long, s long").collect())) for x in (at_once, kept)]
        assert told[0] == told[1] and blocks.distinct(words, shape).count() <= shape.shards
        packed.unpersist()
        return told[0]

    want = Counter()
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    for _, w in rows:
        want.update(w)
    plain = sorted(str(Row(doc_id=i, s=sum(want[x] for x in w))) for i, w in rows)
    for shape in (blocks.Layout(1), blocks.Layout(4), blocks.Layout(3, 2), blocks.Layout(12), blocks.Layout(16, 3)):
        assert run(shape) == plain, shape
