"""Merkle manifest, token alignment and chat formatting against brute force, with nulls, repeats, ties and empty tables."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import chat_format, merkle_manifest, token_alignment


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- manifest
def proofs_of(rows):
    """(ordinal, leaf, subroot, root, proof, folded_root, verified) of (ordinal, stage, leaf, presented)."""

    def levels_of(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    names = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    shelves = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, r[2])) for s in names}
    built = {s: levels_of([r[2] for r in shelves[s]]) for s in names}
    top = levels_of([built[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, r in enumerate(shelves[s]):
            proof, folded = "", r[3] or r[2]
            for levels, k in ((built[s], i), (top, j)):
                for level in levels[:-1]:
                    run, place = level[k // 8 * 8 : k // 8 * 8 + 8], k % 8
                    proof += "".join(run[:place] + run[place + 1 :])
                    folded = sha("".join(run[:place]) + folded + "".join(run[place + 1 :]))
                    k //= 8
            out.append((r[0], r[2], built[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "ordinal long, stage string, leaf string, presented string"


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest(spark, height):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, "", "小学", "初中", "é", "z"]) if k < 300 else "hot", sha(str(k)), None if k % 3 else sha(f"x{k}")) for k in range(900)]
    rows += [(7, "小学", sha("7"), None)] * 90 + [(None, "hot", sha("n"), None), (None, "hot", sha("m"), None), (9000, "lone", sha("l"), None)]
    rows += [(k, f"shelf {k}", sha("s"), None) for k in range(2000, 2030)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"tree": F.lit(1), "copies": F.lit("x"), "root": F.lit(0)})
    made = merkle_manifest.build_manifest(table, presented="presented", height=height)
    assert sorted(map(tuple, merkle_manifest.prove(made).collect()), key=str) == proofs_of(rows)
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert sorted(map(tuple, merkle_manifest.prove(merkle_manifest.build_manifest(one, height=height)).collect()), key=str) == proofs_of([(*rows[0][:3], None)])
    assert merkle_manifest.prove(merkle_manifest.build_manifest(table.limit(0))).count() == 0


def test_leaf_and_addresses(spark):
    row = spark.createDataFrame([(3, None, "", "é1")], "ordinal long, source string, stage string, text string")
    leaf = row.select(merkle_manifest.leaf_digest(*map(F.col, row.columns))).first()[0]
    assert leaf == sha("1:3-0:3:é1")
    for levels in range(1, 6):
        places = [p for d in range(levels) for p in merkle_manifest.places(levels, d).tolist()]
        assert sorted(places) == list(range(merkle_manifest.n_cells(levels)))
    # halves: the upper two levels first, then every lower subtree in one piece
    assert merkle_manifest.address(4, 1, 7) == 8 and merkle_manifest.address(4, 2, 1) == 9 + 9 and merkle_manifest.address(4, 3, 8) == 9 + 9 + 1


# ---------------------------------------------------------------- alignment
LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"


def test_alignment(spark):
    left, right = public_tokenizers.path(LEFT), public_tokenizers.path(RIGHT)
    own, a_tok, b_tok = token_alignment.aligner(left, right), Tokenizer.from_file(left), sentencepiece.SentencePieceProcessor(model_file=right)
    a_tok.encode_special_tokens = True
    rng = random.Random(2)
    alphabet = [" ", "  ", "\n", "\t", "　", "\xa0", "\x1c", "a", "learning", "don't", "<|endoftext|>", "</s>", "<0x41>", "▁", "é", "你好", "😀", "́", "ﬁ", "12,5", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 12))) for _ in range(800)]
    texts += [None, "", " ", "one word", "one word", "y" * 5000, "plain words " * 3000, "x " + "z" * 200]
    texts += [f"ab{chr(c)} cd {chr(c)}ef g{chr(c)}" for c in range(1, 0x3100)]
    rows = [(k if k % 50 else None, t) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "ordinal long, text string").withColumns({"groups": F.lit(1), "links": F.lit("x")})
    shown, links, counts = [], [], {}
    for _, text in rows:
        a, b = (a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)) if text else ([], [])
        sides, ends = [], []
        for ids, names in ((a, own.a_bytes), (b, own.b_bytes)):
            at, found = 0, []
            for k in ids:
                at += len(names[k])
                found.append(at)
            sides.append(b"".join(names[k] for k in ids))
            ends.append(found)
        if not text or any(s != (" " + text).encode() for s in sides):
            shown.append(None)
            links.append([])
            continue
        groups, low = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(k) for k, e in zip(ids, found) if low < e <= cut) for ids, found in ((a, ends[0]), (b, ends[1]))))
            low = cut
        shown.append((len(a), len(b), len(groups), ";".join(groups)))
        links.append([(x, y) for x, e in zip(a, ends[0]) for y, f in zip(b, ends[1]) if e == f])
        for pair in links[-1]:
            counts[pair] = counts.get(pair, 0) + 1
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    want = []
    for (k, _), s, pairs in zip(rows, shown, links):
        tail = (len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs))
        want.append((k, *(s[:3] if s else (0, 0, 0)), *tail, s[3] if s else ""))
    got = token_alignment.align_tokens(table, left, right)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    aligned = token_alignment.align_texts(table, left, right)
    assert {(r.a_id, r.b_id): r.n for r in token_alignment.linked_pairs(aligned, left, right).collect()} == counts
    assert token_alignment.align_tokens(table.limit(0), left, right).count() == 0


def test_pieces_are_kept_in_two_generations(monkeypatch):
    monkeypatch.setattr(token_alignment, "CACHE_PIECES", 5)
    own = token_alignment.Aligner(public_tokenizers.path(LEFT), public_tokenizers.path(RIGHT))
    texts = [f"word{k % 7} other{k % 11} word{k % 3}" for k in range(60)]
    assert [own.aligned([t]) for t in texts] == [own.aligned([t]) for t in texts]
    assert len(own.kept) < 8 and len(own.older) < 8


# ---------------------------------------------------------------- chats
def test_records_of_many_layouts_become_turns(spark):
    records = [
        ('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": null}], "extra": {"x": 1}}', "messages", [("user", "q"), ("assistant", "")]),
        ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": 3}]}', "shared", [("user", "q"), ("assistant", "a"), ("tool", "3")]),
        ('{"system": "s", "prompt": "q", "completion": "a"}', "prompt", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ('{"prompt": "q", "response": ""}', "answer", [("user", "q"), ("assistant", "")]),
        ('{"instruction": "do", "input": "this", "output": "done"}', "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
        ('{"instruction": "do", "input": "", "output": "done"}', "instruction", [("user", "do"), ("assistant", "done")]),
        ('{"query": "maths", "options": [{"title": "A"}, {"title": "B"}]}', "selection", [("user", "maths"), ("assistant", "A\nB")]),
        ('{"role": "user", "text": "t"}', "turn", [("user", "t")]),
        ('{"prompt": "only"}', None, []),
        ('{"messages": []}', None, []),
        ("no json", None, []),
        (None, None, []),
    ]
    table = spark.createDataFrame([(k, r[0]) for k, r in enumerate(records)], "ordinal long, record string").withColumn("layout", F.lit("own"))
    got = {r.ordinal: (r.layout, [tuple(t) for t in r.turns]) for r in chat_format.canonical_json(table, "record").collect()}
    assert got == {k: r[1:] for k, r in enumerate(records)}
    typed = [
        ("struct<prompt:string,completion:string>", '{"prompt": "q", "completion": "a"}', [("user", "q"), ("assistant", "a")]),
        ("struct<messages:array<struct<role:string,content:string>>,meta:int>", records[0][0], records[0][2]),
        ("struct<query:string,options:array<struct<title:string,rank:int>>>", records[6][0], records[6][2]),
        ("struct<instruction:string,input:string,output:string,system:string>", '{"instruction": "do", "output": "x", "system": "s"}', [("system", "s"), ("user", "do"), ("assistant", "x")]),
    ]
    for schema, text, turns in typed:
        rows = spark.createDataFrame([(text,)], "r string").select(F.from_json("r", schema).alias("r")).select("r.*")
        assert [tuple(t) for t in chat_format.canonical_turns(rows).first().turns] == turns
    with pytest.raises(ValueError, match="no layout"):
        chat_format.canonical_turns(spark.createDataFrame([("x",)], "prompt string"))
    twice = (chat_format.Layout("a", (chat_format.Row("x", "y"),)), chat_format.Layout("b", (chat_format.Said("user", ("x", "y")),)))
    with pytest.raises(ValueError, match="same paths"):
        chat_format.fingerprints(twice)


def test_formatted_chats_read_back(spark):
    rng = random.Random(3)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[TURN]", "[TEXT]", " [TEXT] ", "[/TURN]", "\\", "\\\\", " ", "\n", "ok", "é你😀", "[", "<", "/INST]", "$1"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "a [TEXT] b", "[INST]"]
    rows = []
    for key in range(150):
        for turn in range(rng.randrange(1, 8)):
            rows.append((key, turn, rng.choice(roles), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 9)))])))
    rows += [(None, 1, "user", "n"), (None, None, "assistant", "first"), (500, 1, "user", "same"), (500, 1, "user", "same"), (500, 1, "assistant", "b" * 40000)]
    rows += [(600, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(400)]
    table = spark.createDataFrame(rows, "conv long, turn long, role string, text string").withColumn("formatted", F.lit("own"))
    chats = chat_format.collect_turns(chat_format.canonical_turns(table, ["role", "text"]), "conv", "turn")
    out = chat_format.format_chats(chats)
    shown = out.select("conv", "turns", "formatted", "loss", chat_format.read_turns(F.col("formatted")).alias("back"), chat_format.loss_texts(F.col("formatted"), F.col("loss")).alias("learned"))
    want = {}
    for key, turn, role, text in rows:
        want.setdefault(key, []).append((turn is not None, turn or 0, role or "", text or ""))
    got = shown.collect()
    assert {r.conv for r in got} == set(want) and len(got) == len(want)
    for r in got:
        turns = [t[2:] for t in sorted(want[r.conv])]
        assert [tuple(t) for t in r.back] == turns
        assert r.learned == [text for role, text in turns if role == "assistant"]
        assert all(r.formatted[s.start - 4 : s.start] == "<s> " and r.formatted[s.end : s.end + 5] == " </s>" for s in r.loss)
    empty = chat_format.format_chats(spark.createDataFrame([(None,), ([],)], f"turns {chat_format.TURNS}")).collect()
    assert [(r.formatted, r.loss) for r in empty] == [("", []), ("", [])]
    assert chat_format.format_chats(chats.limit(0)).count() == 0
