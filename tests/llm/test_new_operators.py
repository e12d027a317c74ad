"""Fill-in-the-middle, conversation repair and sketched duplicates against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdant.llm import sketches
from verdant.llm.common import ship
from verdant.llm.dialogues import Repair, damaged, repair_report, repaired_turns
from verdant.llm.infill import as_words, code_points, fill_in_middle, rank, restored, select, unit_ends
from verdant.llm.queries import QUERIES
from verdant.llm.sketches import bands_for, fast_sketches, sketched_duplicates

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, node bigint, key string, bands int, n int, form string, output string, root int"
EXTRA = (1, "k", 2, 3, "plain", "o", 4)
TURNS = "conv_id bigint, turn bigint, role string, text string, phase int, digest string, copies string, fault int"
MORE = (9, "x", "y", 0)


@pytest.fixture(scope="module")
def docs(spark):
    return ship(spark).read.parquet(f"{SF}/documents.parquet")


def make_docs(spark, rows):
    return ship(spark).createDataFrame([(i, t, *EXTRA) for i, t in rows], DOCS)


# --- fill in the middle ---------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_infill(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def odd_texts():
    rng = random.Random(5)
    alphabet = ["a", "b", " ", "\n", "\t", "\x0b", "\x0c", "\r", "é", "漢", "\U0001f600", "\x00", "\x08", "\x0e", "\x1f", "!", "\x7f", "<", "P>",
                " ", "\u0085", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return texts + [None, "", " ", "\n\n", "a", " a", "a ", "a <P> b", "x<S>", "<<S", "<", "é" * 9, "z" * 70_000 + " y" * 40_000]


def test_infill_equals_brute_force_on_odd_texts(spark):
    rows = list(enumerate(odd_texts())) + [(None, "one two three"), (None, None), (7, "again a b"), (7, "again a b")]
    got = fill_in_middle(make_docs(spark, rows)).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r[:6]) for r in got) == Counter(brute_infill(*r) for r in rows)
    assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_infill_query_equals_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((*brute_infill(i, t)[:5], sha(brute_infill(i, t)[5]), sha(t or "")) for i, t in rows)
    assert Counter(tuple(r) for r in QUERIES["op11_fill_in_middle"](spark, SF).collect()) == want


def test_infill_empty_table(spark):
    assert fill_in_middle(make_docs(spark, [])).collect() == []


def test_ranks_and_selects_of_every_position():
    data = np.frombuffer("a bé\n\n漢 x  yz ".encode() * 7, np.uint8)
    bounds = np.array([0, 5, 5, 40, len(data)])
    x = as_words(data)
    for marks, truth in ((unit_ends(x, bounds), None), (code_points(x), (data & 0xC0) != 0x80)):
        at = np.arange(len(data) + 1)
        r = rank(marks, at)
        if truth is not None:
            assert (r == np.concatenate([[0], np.cumsum(truth)])).all()
        k = np.arange(1, r[-1] + 1)
        behind = select(marks, k)
        assert (rank(marks, behind) == k).all() and (rank(marks, behind - 1) == k - 1).all()


# --- conversations --------------------------------------------------------------

def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(initials, classes):
    """(cost, ASCII-least audit) by trying all edits from every state, cheapest first."""
    from functools import lru_cache

    nexts, n = {0: 2, 1: 2, 2: 3, 3: 2}, len(initials)

    @lru_cache(None)
    def best(i, q, inserted):
        found = [(0, "")] if i == n and q in (0, 3) else []
        if inserted < 3:
            c, a = best(i, nexts[q], inserted + 1)
            found.append((c + 3, "I" + a))
        if i < n:
            c, a = best(i + 1, q, 0)
            found.append((c + 4, "D" + a))
            if classes[i] not in "bd":
                extra = 3 if classes[i] == "t" else 0
                c, a = best(i + 1, nexts[q], 0)
                found.append((c + 3 + extra, "R" + a))
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, initials[i]))
                if kept is not None:
                    c, a = best(i + 1, kept, 0)
                    found.append((c + extra, "K" + a))
        return min(found, default=(1 << 40, ""))

    return best(0, 0, 0)


def brute_report(rows, damage=True):
    by = defaultdict(list)
    for conv, turn, role, text in (brute_damage(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x)
                                                                       for c, t, r, x in rows]):
        by[conv].append((turn, role, text))
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(by[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
        seen, classes = set(), ""
        for turn, role, text in turns:
            words = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            classes += "b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else "k"
            seen.add((role, text))
        have = [t[0] for t in turns if t[0] is not None]
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(turns, turns[1:])]
        cost, audit = brute_repair([t[1][:1] for t in turns], classes)
        lines, q, at = [], 0, 0
        for e in audit:
            if e == "D":
                at += 1
                continue
            if e == "K" and turns[at][1][:1] == "s":
                q, role = 1, turns[at][1]
            else:
                q = 3 if q == 2 else 2
                role = turns[at][1] if e == "K" else ("assistant" if q == 3 else "user")
            lines.append(f"{role}:{'' if e == 'I' else turns[at][2]}")
            at += e != "I"
        out[conv] = (max(have) - min(have) + 1 - len(set(have)) if have else 0, classes.count("b"), classes.count("d"),
                     classes.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def make_turns(spark, rows):
    return ship(spark).createDataFrame([(*r, *MORE) for r in rows], TURNS)


def odd_turns(seed, convs):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        texts = ["Yes.", "No!", "Why?", "open", "", " \n", "a. \t", "x. ", None, "é.", "Ok.\x00"]
        for _ in range(rng.randint(1, 14)):
            turn = None if rng.random() < 0.1 else rng.randint(0, 12)
            rows.append((None if conv == 3 else conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None, "sys", "User"]),
                         rng.choice(texts)))
        rows += rng.sample(rows, 1)
    return rows


@pytest.mark.parametrize("damage", [True, False])
def test_repair_equals_brute_force_on_odd_turns(spark, damage):
    rows = odd_turns(1, 300)
    got = repair_report(make_turns(spark, rows), damage).collect()
    assert len(got) == len({r[0] for r in rows})
    want = brute_report(rows, damage)
    assert {r["conv_id"]: tuple(r[1:]) for r in got} == want


def test_repair_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_conversation_repair"](spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r[1:]) for r in got.collect()} == brute_report(rows)


def test_repair_of_every_short_conversation():
    for n in range(5):
        for codes in itertools.product([0, 1, 2, 3, 5, 9, 10], repeat=n):
            repair = Repair(bytes(codes))
            audit = "".join(repair.step()[1] for _ in codes) + "I" * len(repair.rest())
            want = brute_repair(["suao"[c & 3] for c in codes], ["d" if c & 4 else "t" if c & 8 else "k" for c in codes])
            assert (repair.cost, audit) == want


def test_repaired_turns_follow_the_form_and_give_the_digest(spark):
    rows = odd_turns(2, 120)
    turns = make_turns(spark, rows)
    text = defaultdict(list)
    for r in repaired_turns(turns, damage=True).orderBy("conv_id", "place").collect():
        text[r["conv_id"]].append((r["place"], r["role"], r["text"]))
    for r in repair_report(turns).collect():
        have = text[r["conv_id"]]
        assert [p for p, *_ in have] == list(range(len(have)))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in have))
        joined = "\n".join(f"{role}:{t}" for _, role, t in have)
        assert hashlib.sha256(joined.encode()).hexdigest() == r["repaired_sha256"]


def test_one_conversation_of_many_turns_holds_few_vectors(spark):
    codes = bytes(random.Random(3).choice([0, 1, 2, 3, 5, 9, 10]) for _ in range(40_000))
    repair = Repair(codes)
    assert len(repair.checkpoints) <= 202 and repair.block == 200
    for _ in codes:
        repair.step()
        assert len(repair.held) <= 201
    rows = [(1, k % 7000, random.Random(k).choice(["user", "assistant"]), f"t{k % 9000}.") for k in range(15_000)]
    got = repair_report(make_turns(spark, rows), False).collect()[0]
    assert got["duplicate"] == len(rows) - len({(r, t) for _, _, r, t in rows}) and got["gaps"] == 0


def test_repair_empty_table_and_dropped_conversations(spark):
    assert repair_report(make_turns(spark, [])).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair_report(make_turns(spark, [(gone, 0, "user", "Hello.")])).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert damaged(make_turns(spark, [(gone, 0, "user", "Hello.")])).collect() == []


# --- sketched duplicates --------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return ({tuple(words[k:k + 4]) for k in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set())


def brute_components(rows):
    sets = [brute_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    by = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            by[g].append(k)
    done = set()
    for k, s in enumerate(sets):
        for j in {j for g in s for j in by[g] if j > k}:
            common = len(s & sets[j])
            if (k, j) not in done and 100 * common >= 80 * (len(s) + len(sets[j]) - common):
                top[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), i if not s else least.get(find(k)), i == (i if not s else least.get(find(k))))
                   for k, ((i, _), s) in enumerate(zip(rows, sets)))


def near_copies(seed, groups=12):
    rng = random.Random(seed)
    rows, word = [], lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 8, 40, 200]))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(len(base) // 60, 1))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((rng.randint(0, 10_000), " ".join(copy)))
            base = copy if rng.random() < 0.5 else base  # chains
    rows += [(1, None), (2, ""), (3, " \n "), (None, rows[0][1]), (None, "lonely words in a row"), (None, None), rows[1], rows[1],
             (4, "A b C"), (5, "a B c"), (6, "ü é ñ 漢字 \U0001f600 x"), (7, "x " * 5000)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # several salts and blocks
        monkeypatch.setattr(sketches, "STAR_ROWS", 2)
        monkeypatch.setattr(sketches, "BLOCK_ROWS", 2)
    rows = near_copies(seed)
    assert Counter(tuple(r) for r in sketched_duplicates(make_docs(spark, rows)).collect()) == brute_components(rows)


def test_components_of_the_small_table(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in QUERIES["op13_sketched_duplicates"](spark, SF).collect()) == brute_components(rows)


def test_pairs_that_no_head_joins_are_verified(spark, monkeypatch):
    """One band of one row: everything shares a bucket, but the head is like nobody."""
    monkeypatch.setattr(sketches, "band_hashes", lambda sketch, bands, rows: np.ones((len(sketch), bands), np.int64))
    monkeypatch.setattr(sketches, "BLOCK_ROWS", 3)
    rng = random.Random(9)
    rows = []
    for group in range(9):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(60)]
        rows += [(100 * group + k, " ".join([*base[:-1], f"end{k}"])) for k in range(1 if group == 0 else 7)]
    got = sketched_duplicates(make_docs(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows)


def test_sketches_fill_every_bin_and_estimate_jaccard():
    rng = np.random.default_rng(3)
    bins, errors = 186, []
    for size in (1, 2, 5, 40, 400, 3000):
        pool = rng.integers(1, 1 << 63, 2 * size, dtype=np.uint64)
        a, b = np.sort(pool[:size]), np.sort(pool[size // 9: size + size // 9])
        sketch = fast_sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bins)
        assert (sketch != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        alone = fast_sketches(b, np.array([0, len(b)]), bins)
        assert (alone[0] == sketch[1]).all()  # whatever else is sketched with it
        common = len(np.intersect1d(a, b))
        errors.append(abs((sketch[0] == sketch[1]).mean() - common / (len(a) + len(b) - common)))
    assert max(errors) < 0.15


def test_bands_for_states_what_cannot_be_had():
    assert bands_for() == (31, 6)
    with pytest.raises(ValueError):
        bands_for(5, 0.9999, 16)


def test_sketched_empty_table(spark):
    assert sketched_duplicates(make_docs(spark, [])).collect() == []


# --- decontamination: equal short items -------------------------------------------

def brute_contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - window + 1, 1) if w else 0):
            windows[tuple(w[k:k + window])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[k:k + size]))):
                    hit.update(range(k, k + size))
                    found |= got
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_equal_and_nested_items_equal_brute_force(spark, block_bytes):
    from verdant.llm.decontaminate import contamination
    long = " ".join(f"w{k % 7}" for k in range(40))
    items = [(k, "Yes") for k in range(30)] + [(k, "yes no") for k in range(30, 40)] + [(40, long), (41, long), (42, "w3 " + long), (43, "no")]
    docs = [(1, "yes " * 500), (2, "no yes no yes"), (3, long + " yes " + long), (4, "clean"), (5, None), (6, long[:40])]
    table = ship(spark).createDataFrame(docs, "doc_id bigint, text string")
    got = contamination(table, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes).collect()
    assert {r["doc_id"]: tuple(r[1:5]) for r in got} == brute_contamination(docs, items)


def test_many_equal_short_items_cost_their_distinct_suffixes():
    """10,000 items "yes" against a document of 200,000: no (item, place) pairs are listed."""
    import tracemalloc

    import pyarrow as pa

    from verdant.llm.decontaminate import _block, _folded_words, _items_of, _shard_hits
    block = _block([str(k) for k in range(10_000)], ["Yes"] * 10_000)
    assert len(block.at) == 1
    tracemalloc.start()
    for lo, hi, w in _folded_words(pa.array(["yes " * 200_000], pa.large_utf8()), 1 << 21):
        row, first, end, suffix, longest = _shard_hits(w, hi - lo, block, 10)
        assert len(row) == 200_000 and len(_items_of(row, suffix, block, 1)[0]) == 10_000
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


# --- clashing names ----------------------------------------------------------------

def test_documents_keep_columns_of_any_name(spark):
    from verdant.llm.lines import without_duplicate_lines
    from verdant.llm.mixing import mixed_documents
    from verdant.llm.near_duplicates import unique_documents
    from verdant.llm.substrings import without_repeats
    names = ["_mix_size", "_mix_key", "_mix_part", "_near_text", "_near_key", "_cut_id", "_cut_spans", "_line_id", "_line_gone",
             "c0", "a.b", "key", "rep", "node"]
    schema = "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, t, "s", *names) for i, t in [(1, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, "")]]
    docs = ship(spark).createDataFrame(rows, schema)
    for op in (mixed_documents, unique_documents, without_repeats, without_duplicate_lines):
        got = op(docs)
        assert got.columns == docs.columns and got.count() > 0, op
        assert {tuple(r)[3:] for r in got.collect()} == {tuple(names)}
        assert op(docs.where("false")).collect() == []


@pytest.mark.parametrize("lines", [1, 3, 7, 10, 14, 41])
def test_a_notice_wrapped_over_any_number_of_lines(spark, lines):
    from verdant.llm.licenses import TEMPLATES, license_scan
    words = max(TEMPLATES["GPL-3.0"], key=lambda t: len(t.split())).split()
    per = -(-len(words) // lines)
    text = "\n".join(" ".join(words[k:k + per]) for k in range(0, len(words), per))
    body = "\n".join(f"line {k} of other prose here" for k in range(60))
    got = license_scan(ship(spark).createDataFrame([(1, body + "\n" + text + "\n" + body, None)], "doc_id int, text string, path string")).first()
    assert got["license"] == "GPL-3.0" and got["score"] > 0.999
