"""The corpus operators on small fixtures: brute force, round trips and odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.llm import bytespans, classifier, licenses, minhash, mixing, packing, pii, rules, topk, wordspans
from loomfield.llm.components import components
from loomfield.llm.oracles import ORACLES
from loomfield.llm.queries import QUERIES, tokenizer
from loomfield.llm.scratch import Scratch
from tests.oracle import differences

TINY = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n long, size string, bin int"


def table(spark, rows):
    """Documents with null cells and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, s, None, "x", None, None, 3) for i, t, s in rows], SCHEMA).repartition(3)


ODD = [(1, None, "a"), (2, "", "b"), (3, "word", None), (3, "word", None), (4, "x " * 30_000, "a"), (5, "a b c d e f", "a"), (6, "a b c d e f", "b"), (None, "a b c d e f", None), (7, " \n\t ", "c"), (8, "ü　ñ " * 60, "a")]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    assert differences(spark, name, TINY, QUERIES, ORACLES) == []


OPERATORS = {
    "bytes": lambda d: bytespans.remove_strings(d),
    "near": lambda d: minhash.near_duplicates(d),
    "packing": lambda d: packing.pack_documents(d, tokenizer()),
    "licenses": lambda d: licenses.scan_documents(d),
    "rules": lambda d: rules.apply_policy(rules.ledger(d), name="verdict"),
    "mixing": lambda d: mixing.mix(d),
    "mixed": lambda d: mixing.mixed(d),
    "pii": lambda d: pii.pseudonymize(d, "k"),
    "words": lambda d: wordspans.remove_spans(d),
    "classifier": lambda d: classifier.classify(d, d.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_and_empty_tables(spark, name):
    rows = OPERATORS[name](table(spark, ODD)).collect()
    if name not in ("packing", "licenses", "mixed"):
        assert len(rows) == len(ODD)
    assert OPERATORS[name](table(spark, ODD).where("false")).count() == 0


def brute_bytes(docs, length):
    raws = [(i, bytespans.encode(t)) for i, t in docs]
    seen = Counter(r[p : p + length] for _, r in raws for p in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(r), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("length", [12, 41])
def test_bytes_against_brute_force(spark, length):
    rnd = random.Random(length)
    base = "".join(rnd.choice("ab\0é") for _ in range(700))
    docs = []
    for i in range(40):
        a, n = rnd.randrange(600), rnd.randrange(10, 100)
        noise = lambda: "".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(60)))
        docs.append((i, noise() + base[a : a + n] + noise() + (base[a + n - 20 : a + n + 30] if i % 3 else "")))
    docs += [(100, None), (102, "x" * 300), (103, "ab" * 80), (104, docs[3][1]), (104, docs[3][1])]
    got = Counter(tuple(r)[:5] for r in bytespans.remove_strings(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), length).collect())
    assert got == brute_bytes(docs, length)


def test_bytes_of_the_registered_length_against_brute_force(spark):
    rnd = random.Random(7)
    prose = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    base = prose(3000)
    docs = []
    for i in range(40):
        a, n = rnd.randrange(2000), rnd.choice([350, 399, 400, 401, 520, 900])
        docs.append((i, prose(rnd.randrange(300)) + base[a : a + n] + prose(rnd.randrange(300))))
    docs += [(50, base), (51, "é" * 700), (52, docs[0][1]), (53, None)]
    got = Counter(tuple(r)[:5] for r in bytespans.remove_strings(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())
    assert got == brute_bytes(docs, 400)


@pytest.mark.parametrize("heavy", [2, 7])
def test_an_anchor_of_very_many_contexts_is_split(spark, monkeypatch, heavy):
    monkeypatch.setattr(bytespans, "HEAVY", heavy)
    rnd = random.Random(heavy)
    passage = "".join(rnd.choice("abcdef") for _ in range(45))
    # a common passage between contexts that agree for some bytes on either side
    sides = ["".join(rnd.choice("xyz") for _ in range(30)) for _ in range(4)]
    docs = []
    for i in range(60):
        left, right = sides[i % 4][rnd.randrange(30) :], sides[i // 4 % 4][: rnd.randrange(30)]
        docs.append((i, f"{i:04d}" * 5 + left + passage + right + f"{-i:04d}" * 5))
    got = Counter(tuple(r)[:5] for r in bytespans.remove_strings(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 41).collect())
    assert got == brute_bytes(docs, 41)


def test_multikey_quicksort_orders_like_bytes():
    rnd = np.random.default_rng(2)
    rows = rnd.integers(0, 3, (700, 4)).astype(np.uint64)
    order = bytespans.multikey_quicksort(rows)
    assert [tuple(r) for r in rows[order]] == sorted(map(tuple, rows))


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 30)] + [(rnd.randrange(2000, 2200), rnd.randrange(2000, 2200)) for _ in range(120)]
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    loops = {a for a, b in edges if a == b}
    want = {x: find(x) for x in list(parent) if x not in loops or any(x in e and e[0] != e[1] for e in edges)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == want


def test_near_duplicates_in_a_messy_group(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rnd.choice(vocabulary) for _ in range(60)]
    docs = []
    for i in range(120):
        words = list(base)
        for _ in range(rnd.randrange(7)):
            words[rnd.randrange(60)] = rnd.choice(vocabulary)
        docs.append((i * 3 % 121, " ".join(words)))
    sets = [(i, {tuple(t.split()[k : k + 5]) for k in range(56)}) for i, t in docs]
    label = {i: i for i, _ in docs}
    changed = True
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if 100 * len(s & t) >= 75 * len(s | t)]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == label


def test_rows_of_one_doc_id_are_one_document(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    docs = [(5, one), (7, one), (7, two), (9, two + " more"), (11, three), (11, three), (12, three), (13, ""), (13, "lonely words here"), (None, one), (20, None)]
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect() if r["doc_id"] is not None)
    assert [(r[0], r[2]) for r in got] == [(5, 5), (7, 5), (7, 5), (9, 5), (11, 11), (11, 11), (12, 11), (13, 13), (13, 13), (20, 20)]
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in minhash.without_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())
    assert left == sorted([(0, one), (5, one), (11, three), (13, ""), (13, "lonely words here"), (20, "")])


def test_blocks_of_leaders_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 1)
    monkeypatch.setattr(minhash, "LEADERS", 2)
    test_near_duplicates_in_a_messy_group(spark)


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.r_[a[:750], rnd.integers(0, 2**63, 250).astype(np.uint64)]
    same = np.mean(minhash.signature(a, 2048) == minhash.signature(b, 2048))
    assert abs(same - 750 / 1250) < 0.05


def test_pieces_rebuild_every_document(spark):
    from tokenizers import Tokenizer

    docs = [(i, t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{TINY}/documents.parquet'").fetchall()] + [(9001, None), (9002, "<|endoftext|> naïve 日本語 🎉"), (9003, "word " * 9000)]
    model = Tokenizer.from_file(tokenizer())
    ids = {i: np.array(model.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in docs}
    pieces = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), tokenizer()).collect()
    place: dict[int, list] = {}
    sequence: dict[int, list] = {}
    for p in pieces:
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())
        place.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for i, own in ids.items():
        assert sum(n for _, n in place[i]) == len(own) and all(a + n == b for (a, n), (b, _) in zip(sorted(place[i]), sorted(place[i])[1:]))
    fills = []
    for parts in sequence.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048
        fills.append(end)
    padded = sum(2048 - f for f in fills if f & (f - 1))
    assert padded < 0.02 * sum(fills)


def test_the_fast_encoder_gives_the_tokenizers_ids():
    rnd = random.Random(9)
    letters = [chr(c) for c in [*range(9, 14), *[32] * 30, *range(33, 256), 0x3000, 0x4E00, 0x1F389]]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(80))) for _ in range(3000)] + ["x" * 3000, " " * 5000, "it's <|endoftext|> we'll", "é" * 999 + " 12 3"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = packing.Encoder(tokenizer(name))
        assert (encoder.fast is not None) == (name == "byte_bpe_50k.json")
        assert [np.frombuffer(e, "<u4").tolist() for e in encoder.encode(texts)] == [encoder.model.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit_takes_the_tightest():
    room = packing.Room(10)
    for sequence, left in enumerate([3, 7, 5]):
        room.put(left, sequence)
    assert room.take(4) == (2, 5) and room.take(4) == (1, 7) and room.take(4) is None and room.take(1) == (0, 3)


def test_policies_and_ablation(spark):
    rows = rules.ledger(table(spark, [(1, "a few words", "s"), (2, "word$ " * 80, "s"), (3, " ".join(f"word{i}" for i in range(80)), "s")]))
    kept = {r["doc_id"]: r["verdict"] for r in rules.apply_policy(rows, "v2", "verdict").collect()}
    assert kept == {1: False, 2: False, 3: True}
    ablated = {r["rule"]: (r["n_failed"], r["n_failed_alone"], r["n_kept_without"]) for r in rules.ablate(rows).collect()}
    assert ablated["few_words"] == (1, 1, 2) and ablated["symbols"] == (1, 0, 1)


def test_unequal_odds_decide_who_gets_the_extra_copy(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2], 1.0 + 9.0 * (i // 2 % 2)) for i in range(400)], "doc_id long, text string, source string, g double")
    rows = mixing.mix(docs, weight="g").collect()
    for source in "ab":
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5 and len({r["copies"] for r in own}) == 2
        likely, other = ([r["copies"] for r in own if (r["doc_id"] // 2 % 2 == 1) == side] for side in (True, False))
        assert np.mean(likely) > np.mean(other) + 0.3
    by_length = mixing.mix(spark.createDataFrame([(i, "w " * (4 if i % 4 < 2 else 400), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")).collect()
    long, short = ([r["copies"] for r in by_length if r["source"] == "a" and (r["size"] > 4) == side] for side in (True, False))
    assert np.mean(long) > np.mean(short)


MIXED_TABLES = {
    "repeated rows at the cut": [(1, "w " * 10, "a")] * 50 + [(2, "v " * 10, "b")] * 50,
    "null and empty source": [(i, "w " * 10, s) for i, s in enumerate([None] * 30 + [""] * 20 + ["x"] * 3)],
    "no ids": [(None, f"word{i % 7} " * 10, "a" if i % 3 else "b") for i in range(120)],
    "one row many times": [(5, "w " * 7, "a")] * 300 + [(i, "w " * 7, "b") for i in range(100, 130)],
    "odd": None,
}


@pytest.mark.parametrize("name", sorted(MIXED_TABLES))
def test_mixed_returns_what_mix_takes(spark, name):
    docs = table(spark, MIXED_TABLES[name] or ODD)
    taken, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    got = Counter()
    for r in mixing.mixed(docs).collect():
        got[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert got == +taken
    if name != "odd":
        assert all(abs(taken[s] - t) <= 10 for s, t in target.items())
    assert Counter(map(tuple, mixing.mix(docs).collect())) == Counter(map(tuple, mixing.mix(docs).collect()))


CLASHES = "row doc copies copy size kept p_low p_toxic low toxic gone again key bin q l0 rest extra words_from target whole text_1 _text _again _size _id _source _low sites quality items n_items id d1 d2 n root least part page".split()


def test_columns_of_the_caller_stay_whatever_their_names(spark):
    rows = [(i, f"some words of document {i} that stand alone {i * 7} " * 3, "en", "ab"[i % 2], *[f"{c}-{i}" for c in CLASHES]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    stages = {
        "mixed": mixing.mixed(docs),
        "single": minhash.without_near_duplicates(docs),
        "judged": classifier.judged(docs, labels, docs.columns).where("kept").select("row.*"),
        "private": pii.pseudonymize(docs, "k", keep=docs.columns, spans=False),
    }
    for name, out in stages.items():
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[c] == f"{c}-{r['doc_id']}" for r in got for c in CLASHES), name
    for op in (OPERATORS[n] for n in ("bytes", "near", "packing", "licenses", "rules", "mixing", "words")):
        op(docs).collect()


def test_topk_with_unusable_vectors(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(300)] + [(300, None), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (None, [0.1] * 6), (600, [0.5] * 6), (601, [0.5] * 6), (602, [0.5] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = {i: np.floor(1024 * np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in usable if i % 100 == 0):
        best = sorted(((-int(v @ usable[q]), i) for i, v in usable.items() if i != q))[:10]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    asked = vectors.where("vec_id % 100 = 0")
    assert {tuple(r) for r in topk.search(asked, vectors, pivots=8, block=16).collect()} == want
    assert topk.search(asked.where("false"), vectors).count() == 0 and topk.search(asked, vectors.where("false")).count() == 0


def test_feistel_is_a_permutation():
    net = pii.Feistel(b"k" * 32)
    for n in (1, 2, 10, 997):
        assert sorted(net.permute(i, n, "t") for i in range(n)) == list(range(n))


def test_pseudonyms_keep_formats_and_links():
    names = pii.Pseudonyms(b"k" * 32)
    text = 'Card 4111 1111 1111 1111, again 4111 1111 1111 1111; mail ann.lee7@example.com, +1 (212) 555-0199, 10.1.22.255, 2024-02-29, 31/12/1999, 12/31/1999, SSN 123-45-6789, GB82 WEST 1234 5698 7654 32, token = "0123456789abcdef0123"'
    new, items = names.apply(text)
    assert len(new) == len(text) and [k for k, _, _ in items] == ["card", "card", "email", "phone", "ip", "date", "date", "date", "ssn", "iban", "secret"]
    cards = [new[s:e] for k, s, e in items if k == "card"]
    assert cards[0] == cards[1] != "4111 1111 1111 1111" and pii.luhn(cards[0].replace(" ", ""))
    assert [k for k, _, _ in names.apply(new)[1]] == [k for k, _, _ in items]
    assert names.apply("1234567890123456 is no card, 1.2.3 no address, 2023-02-30 no date") == ("1234567890123456 is no card, 1.2.3 no address, 2023-02-30 no date", [])


def test_pseudonyms_go_back_with_the_key():
    rnd = random.Random(3)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    there, back = pii.Pseudonyms(b"k" * 32), pii.Pseudonyms(b"k" * 32, back=True)

    def card():
        body = "4" + digits(14)
        return next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))

    makers = {
        "card": card,
        "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
        "ip": lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)),
        "email": lambda: "".join(rnd.choice("abcxyz") for _ in range(rnd.choice([3, 9, 150]))) + "@mail.example.com",
        "secret": lambda: "".join(rnd.choice("abcXYZ0189") for _ in range(rnd.choice([16, 40, 300]))),
        "date": lambda: f"{rnd.randrange(1900, 2100)}-{rnd.randrange(1, 13):02d}-{rnd.randrange(1, 29):02d}",
        "ssn": lambda: f"{rnd.randrange(1, 666):03d}-{rnd.randrange(1, 100):02d}-{rnd.randrange(1, 10000):04d}",
    }
    seen: dict[str, str] = {}
    for i in range(300):
        kind = list(makers)[i % len(makers)]
        value = makers[kind]()
        text = f"some words {'token = ' if kind == 'secret' else ''}{value} and more words"
        new, items = there.apply(text)
        # found where it was planted, by a search of its own, and nothing else is touched
        assert [k for k, _, _ in items] == [kind] and text[items[0][1] : items[0][2]] == value
        at = text.index(value)
        assert new[:at] == text[:at] and new[at + len(value) :] == text[at + len(value) :]
        assert back.apply(new)[0] == text
        assert seen.setdefault(value, new[at : at + len(value)]) == new[at : at + len(value)]
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("phone", ["+44 20 7946 0958", "+33 1 23 45 67 89", "+34 912 34 56 78", "1-800-555-1234", "+1 (212) 555-0199", "+12125550199", "212-555-0199", "(212) 555-0199", "+49 (0) 30 123456"])
def test_phones_of_many_forms(phone):
    new, items = pii.Pseudonyms(b"k" * 32).apply(f"call {phone} now")
    assert items == [("phone", 5, 5 + len(phone))] and new != f"call {phone} now"
    assert [c for c in new if not c.isdigit()] == [c for c in f"call {phone} now" if not c.isdigit()]


def test_long_names_are_replaced_whole():
    name = "ab.c" * 5000
    new, items = pii.Pseudonyms(b"k" * 32).apply(f"to {name}@example.com")
    assert items == [("email", 3, 3 + len(name) + 12)] and not any(new[i : i + 20] in name for i in range(3, 3 + len(name) - 20))


def test_pseudonyms_need_a_key(spark):
    with pytest.raises(ValueError):
        pii.pseudonymize(table(spark, ODD), "")


class Everywhere(licenses.Scanner):
    """Aligns every template at every place: no fingerprints."""

    def candidates(self, ids):
        return [(t, d) for t in range(len(self.ids)) for d in range(-len(self.ids[t]), len(ids), licenses.BAND // 2)]


def test_licenses_against_alignment_everywhere():
    rnd = random.Random(8)
    short = {name: [w for w in wordings if len(w) < 330][:3] for name, wordings in licenses.TEMPLATES.items()}
    index, brute = licenses.Scanner(short), Everywhere(short)
    filler = ["river", "stone", "the", "license", "cloud", "of", "software", "paper", "version"]
    for i in range(60):
        name = rnd.choice(list(short))
        words = rnd.choice(short[name] or short["MIT"]).split()
        for _ in range(len(words) // 12):
            words[rnd.randrange(len(words))] = rnd.choice(filler)
        text = " ".join([rnd.choice(filler) for _ in range(rnd.randrange(12))] + words + [rnd.choice(filler) for _ in range(rnd.randrange(12))])
        got, want = index.scan(text), brute.scan(text)
        assert [(m[0], m[1], m[3]) for m in got] == [(m[0], m[1], m[3]) for m in want], text


def test_license_spans_count_the_given_text():
    text = "İİİ Released under the MİT License. Released under the MIT License."
    assert [text[m[4] : m[5]] for m in licenses.Scanner().scan(text) if m[2] == 1.0] == ["Released under the MIT License"]


def test_license_with_noise_and_plain_text():
    scan = licenses.Scanner()
    found = scan.scan("Some words. Released under the MIT License.\nThis work is licensed, under the GNU General Public License version 3.")
    assert [f[0] for f in found] == ["MIT", "GPL-3.0"]
    full = licenses.TEMPLATES["MIT"][-1].replace("sublicense", "sub license").replace("Software", "program", 1)
    (name, _, coverage, *_), = scan.scan("Intro text here. " + full + " And after.")
    assert name == "MIT" and 0.9 < coverage < 1
    assert scan.scan("the work is under the version of this public domain") == []


def test_winnowing_finds_shared_runs():
    a = np.arange(1, 30)
    b = np.r_[np.full(7, 99), a[10:20], np.full(5, 98)]
    assert set(licenses.fingerprints(a)[0].tolist()) & set(licenses.fingerprints(b)[0].tolist())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    rows = classifier.classify(docs, train).join(test, "doc_id").collect()
    low = [(r["p_low"] > 0.5, r["quality"] == 0) for r in rows]
    assert np.mean([a == b for a, b in low]) > 0.95
    clean = [r for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    assert np.mean([r["kept"] for r in clean]) > 0.97


def test_word_spans_in_levels():
    assert wordspans.levels(13) == [4, 7] and wordspans.levels(100) == [4, 7, 13, 25, 50]
