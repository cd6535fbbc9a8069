"""Collocations, Merkle manifest and chat formatting against brute force on small tables."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from frames import same_rows
from pyspark.sql import functions as F

from wealthspark.llm import chat, collocations, merkle
from wealthspark.llm.queries import LEAF, ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words binary, key string, n int, index int"


def table(spark, rows):
    return spark.createDataFrame([(*r, b"clash", "clash", 1, 2) for r in rows], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("name", ["op11_collocations", "op12_merkle", "op13_chat"])
def test_registered(spark, duck, data, name):
    same_rows(QUERIES[name](spark, data).toPandas(), duck.sql(ORACLE_SQL[name]).df())


# --- collocations


def brute_phrases(rows, least, top):
    count, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 5):
                    if i + k <= len(words):
                        count[lang, tuple(words[i : i + k])] += 1
    out = collections.defaultdict(list)
    longer = collections.defaultdict(int)
    for (lang, p), a in count.items():
        if a >= least:
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[lang, p[i : i + size]] = max(longer[lang, p[i : i + size]], a)
    for (lang, p), a in count.items():
        if len(p) > 1 and a >= least and 100 * longer[lang, p] < 80 * a:
            cuts = [(2000000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    got = []
    for lang, found in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            got.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(got)


def prose(seed=3):
    r = random.Random(seed)
    words = [r.choice("ab cd é 漢 the of X yz".split()) + str(r.randrange(1, 30)) for _ in range(80)] + ["the"] * 40 + ["of", "The"] * 15
    fixed = [" ".join(r.choice(words) for _ in range(r.randint(2, 6))) for _ in range(12)]
    out = [None, "", " \t ", "...", "one", "a\tb c\x0bd\x1ce"]
    for k in range(220):
        parts = [r.choice(fixed) if r.random() < 0.4 else r.choice(words) for _ in range(r.randint(1, 40))]
        out.append("".join(p + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! "]) for p in parts))
    return out


@pytest.mark.parametrize("budget", [1 << 21, 60, 7])
def test_phrases(spark, budget, monkeypatch):
    """Small budgets lengthen prefixes up to whole phrases; small chunks and blocks cut texts and rows anywhere."""
    if budget < 100:
        monkeypatch.setattr(collocations, "GROUPS", 1 << 30)
    rows = [(k, t, [None, "en", "en", "fr"][k % 4], "s", 1) for k, t in enumerate(prose())]
    rows += rows[7:9]
    got = collocations.phrases(spark, table(spark, rows).repartition(3), least=6, top=50, budget=budget)
    assert sorted(map(tuple, got.collect())) == brute_phrases([(r[2], r[1]) for r in rows], 6, 50)


def test_phrases_edges(spark):
    assert collocations.phrases(spark, table(spark, [])).count() == 0
    assert collocations.phrases(spark, table(spark, [(1, None, None, None, None)])).count() == 0
    rows = [(k, "a b " * 40, "en", "s", 1) for k in range(3)]  # ties; one hot pair
    got = collocations.phrases(spark, table(spark, rows), top=3).collect()
    assert [tuple(r) for r in got] == [r for r in brute_phrases([(r[2], r[1]) for r in rows], 30, 3)]


def test_chunks_cut_no_word(monkeypatch):
    text = "Alpha beta, gamma\tdelta " * 30 + "x" * 500
    whole = [t for part in collocations._chunks(text) for t in part]
    monkeypatch.setattr(collocations, "CHUNK", 7)
    parts = list(collocations._chunks(text))
    assert len(parts) > 30 and [t for part in parts for t in part] == whole


def test_blocks_overlap(monkeypatch):
    """Suffixes reach over the ends of blocks and of chunks."""
    import numpy as np
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["en"] * 2), pa.array(["a b c d e. f g " * 5, "h"])], ["lang", "text"])
    every = collocations.Frequent(np.full(1 << 23, 255, np.uint8))
    want = np.concatenate([rows for _, rows in collocations._blocks(iter([batch]), 0, every)])
    monkeypatch.setattr(collocations, "BLOCK", 3)
    got = np.concatenate([rows for _, rows in collocations._blocks(iter([batch]), 0, every)])
    assert (got == want).all() and len(got) == 4 + 4 * 6 + 1


def test_parts_keep_the_budget():
    r = random.Random(1)
    counts = {(k,): r.randint(1, 120) for k in range(1, 300)}
    parts = collocations.Parts(counts, 100, sum(counts.values()))
    loads = collections.Counter()
    for p, n in counts.items():
        loads[parts.group[p]] += n if parts.group[p] >= 0 else 0
    assert max(loads.values()) <= 100 and {p for p, g in parts.group.items() if g < 0} == {p for p, n in counts.items() if n > 100}


# --- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(leaves):
    """The root and each leaf's siblings, level by level with the leaf's place."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, place in enumerate(at):
            run = level[place // 8 * 8 : place // 8 * 8 + 8]
            proofs[k].append((place % 8, run[: place % 8] + run[place % 8 + 1 :]))
            at[k] = place // 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], proofs


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        groups[lang].append((doc_id, brute_leaf((doc_id, source, lang, n_chars, text)), brute_leaf((doc_id, source, lang, n_chars, text and lower(text)))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = brute_tree([leaf for _, leaf, _ in groups[g]])
    root, tops = brute_tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for (doc_id, leaf, changed), proof in zip(groups[g], trees[g][1]):
            back = changed if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else leaf
            for place, others in proof + top:
                back = sha("".join([*others[:place], back, *others[place:]]))
            out.append((doc_id, leaf, trees[g][0], root, sha("".join(x for _, others in proof + top for x in others)), back, back == root))
    return sorted(out, key=str)


def documents(n):
    r = random.Random(n)
    rows = [(k, r.choice(["Some Text é", "all lower", "", None, "X" * 3000]), r.choice(["en"] * 6 + ["fr", None, "", "É"]), r.choice(["s", None]), r.choice([5, None])) for k in range(n)]
    return rows + [(None, "Null id", "en", None, None), (3, "A", "en", "s", 1), (3, "A", "en", "s", 1), (3, "B", "en", "s", 1)] if n else rows


@pytest.mark.parametrize("power", [1, 2, 4])
def test_manifest(spark, power):
    """Small blocks make several passes up and down; one to a thousand leaves, languages of one row and of many."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    for rows in ([(7, "Only", "en", "s", 1)], documents(700)):
        got = merkle.manifest(spark, table(spark, rows).repartition(3), LEAF, "lang", tampered=tampered, power=power)
        shown = got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
        assert sorted(map(tuple, shown.collect()), key=str) == brute_manifest(rows)
    for r in got.collect():
        assert sha(merkle.siblings(r["proof"])) == r["proof_sha256"] and merkle.folded(r["leaf"], r["proof"]) == r["root"]


def test_manifest_of_many_groups(spark):
    rows = [(k, "T", f"lang{k % 90}", "s", 1) for k in range(300)]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = merkle.manifest(spark, table(spark, rows), LEAF, "lang", tampered=tampered, proofs=False, power=1).drop("proof")
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)


def test_manifest_empty(spark):
    assert merkle.manifest(spark, table(spark, []), LEAF, "lang").count() == 0


def test_queue_stays_small(monkeypatch):
    seen = []
    push = merkle.heappush
    monkeypatch.setattr(merkle, "heappush", lambda q, x: (push(q, x), seen.append(len(q))))
    levels = merkle.climbed([sha(str(k)) for k in range(4000)], 4)
    assert max(seen) <= 8 * 4 and levels[4][0] == brute_tree([sha(str(k)) for k in range(4000)])[0]
    seen.clear()
    merkle.descended(levels, "")
    assert max(seen) <= 8 * 4


# --- chat formatting

NASTY = ["\\### Assistant: </turn> ok", "", "A", "B", "<", "</turn>", "</turn", "\\", "\\\\", "####", "### user: x</turn>\n", "é漢\n\n", ": ", "B</turn>\nA", None, "x" * 70_000]


def chats(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, place int")


def conversations():
    r = random.Random(5)
    rows = [(k, t, role, r.choice(NASTY)) for k in range(12) for t, role in enumerate(r.choices(["user", "assistant", "system", "a: b#", None, "### x"], k=r.randint(1, 9)))]
    rows += [(77, t, ["user", "assistant"][t % 2], r.choice(NASTY[:-1])) for t in range(200)]  # longer than a window
    rows += [(None, 0, "user", "null id"), (None, 1, "assistant", "yes"), (5, 0, "user", "again"), (5, 0, "user", "again"), (6, None, "assistant", "no turn")]
    return rows


def turn_order(row):
    return (row[1] is not None, row[1] or 0, (row[2] or "").encode(), (row[3] or "").encode())


def test_read_back(spark):
    groups = collections.defaultdict(list)
    for row in conversations():
        groups[row[0]].append(row)
    formatted = chat.format_turns(spark, chats(spark, conversations()).repartition(3))
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert got.keys() == groups.keys()
    for conv, rows in groups.items():
        rows.sort(key=turn_order)
        turns = [(role or "", text or "") for _, _, role, text in rows]
        said = [t for role, t in turns if role == "assistant"]
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (sum(map(len, said)), sha("".join(said)))
        assert r["formatted_chars"] == len(chat.plain_template(turns)) and chat.parsed(chat.plain_template(turns)) == turns


def templates():
    """Functions of this call, so that they travel to the workers by value."""

    def with_end(turns):
        return "<s>" + "".join(f"[{role}]{text}" for role, text in turns) + "</s>"

    def forgetful(turns):
        """Only the last answer keeps what it thought."""
        last = max((k for k, (role, _) in enumerate(turns) if role == "assistant"), default=-1)
        return "".join(f"<{role}>{text if k == last or role != 'assistant' else text.split('#')[-1]}\n" for k, (role, text) in enumerate(turns))

    def counting(turns):
        return f"{len(turns)} turns\n" + "".join(f"{role}: {text}\n" for role, text in turns)

    return {"plain": chat.plain_template, "with_end": with_end, "forgetful": forgetful, "counting": counting}


@pytest.mark.parametrize("name,rewrites", [("plain", False), ("with_end", False), ("forgetful", True), ("counting", True)])
def test_templates(spark, name, rewrites):
    """Edits give the template's output after every turn; texts lie in their spans; rewriting templates are found out."""
    template = templates()[name]
    rows = [(1, t, ["user", "assistant"][t % 2], f"q{t}</s" if t % 2 == 0 else f"think#say {t}") for t in range(8)]
    output, turns, found = "", [], []
    for r in chat.format_turns(spark, chats(spark, rows), template).orderBy("place").collect():
        turns.append((r["role"], rows[r["place"]][3]))
        output = output[: r["keep"]] + r["piece"]
        assert output == template(turns)
        shown = output[r["start"] : r["end"]]
        assert (chat.unescaped(shown) if name == "plain" else shown) == turns[-1][1]
        found.append(r["rewrites"])
    assert any(found) == rewrites and not found[0]
    if name == "forgetful":
        assert found == [False, False, False, True, False, True, False, True]


@pytest.mark.parametrize("name", ["plain", "with_end", "forgetful", "counting", "headed"])
def test_templates_see_long_conversations_whole(spark, name):
    """Beyond WINDOW turns, too, each output is the template's for all turns so far, and no rewriting goes unseen."""

    def headed(turns):
        """The first turn stands before all, and all but the last two are cut to a letter: the turn that leaves them is rewritten."""
        return f"{turns[0][1]}|" + "".join(f"{role}: {text if k >= len(turns) - 2 else text[:1]}\n" for k, (role, text) in enumerate(turns))

    template = {**templates(), "headed": headed}[name]
    n = 2 * chat.WINDOW + 20
    rows = [(1, t, ["user", "assistant"][t % 2], f"q{t}</s" if t % 2 == 0 else f"think#say {t}") for t in range(n)]
    output, turns, end = "", [], 0
    for r in chat.format_turns(spark, chats(spark, rows), template).orderBy("place").collect():
        turns.append((r["role"], rows[r["place"]][3]))
        whole = template(turns)
        assert r["rewrites"] == (whole[:end] != output[:end])
        output = output[: r["keep"]] + r["piece"]
        assert output == whole
        shown, end = output[r["start"] : r["end"]], r["end"]
        if name != "headed" or len(turns) > 1:
            assert (chat.unescaped(shown) if name == "plain" else shown) == turns[-1][1]
    assert len(turns) == n


@pytest.mark.parametrize("window", [1, 2, 3, chat.WINDOW])
def test_turn_by_turn_windows(window):
    """Windows change no row of a template that is made turn by turn."""
    turns = [(["user", "assistant"][t % 2], NASTY[t * 7 % len(NASTY)] or "") for t in range(2 * chat.WINDOW + 20)]
    a, b = chat.Renderer(chat.plain_template, window), chat.Renderer(lambda turns: chat.plain_template(turns))
    for turn in turns:
        assert a.add(*turn) == b.add(*turn)
        assert len(a.turns) <= window + 1
    assert len(b.turns) == len(turns)


def test_chat_empty(spark):
    assert chat.read_back(chat.format_turns(spark, chats(spark, []))).count() == 0
