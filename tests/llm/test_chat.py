import hashlib
import random
import re

import pyarrow as pa

from scorelake.llm import chat as C
from scorelake.llm.chat_query import _digests

SCHEMA = "conv_id long, turn long, role string, text string, block string"


def turns():
    rng = random.Random(2)
    parts = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|x|>", "<|", "\\", "\n", "é漢🙂", "plain words", "<\\\\|", "|>", ""]
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))), "b"))
    rows += [(40, None, None, None, "b"), (40, None, "a\nb\\n<|im_end|>", "x", "b"), (40, 1, "assistant", None, "b"), (40, 1, "assistant", None, "b"),
             (None, 3, "assistant", "lost", "b"), (None, 1, "user", "first", "b"), (0, -5, "assistant", "early", "b"), (41, 0, "assistant", "z" * 3_000_000, "b")]
    rows += [(99, i, ("user", "assistant")[i % 2], f"turn {i} <|im_end|>", "b") for i in range(5000)]
    return rows


def grouped(rows):
    out = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1], (r[2] or "").encode(), (r[3] or "").encode())):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_conversations_come_back(spark):
    rows = turns()
    blocks = C.formatted(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = sorted(blocks.collect(), key=lambda r: r.block)
    want = grouped(rows)
    back, masks = {}, {}
    for r in got:
        back.setdefault(r.conv_id, []).extend(C.parsed(r.text))
        masks.setdefault(r.conv_id, []).extend(C.masked(r.text, [s.asDict() for s in r.loss]))
    assert back == want
    assert masks == {k: [t for role, t in v if role == "assistant"] for k, v in want.items()}


def test_digests_of_sorted_blocks(spark):
    rows = [r for r in turns() if r[0] is not None]
    blocks = C.formatted(spark.createDataFrame(rows, SCHEMA)).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    got = {r.conv_id: r for r in blocks.select("conv_id", "text", "loss").mapInArrow(_digests, kinds).collect()}
    want = grouped(rows)
    assert set(got) == set(want)
    for conv, said in want.items():
        loss = "".join(t for role, t in said if role == "assistant")
        assert got[conv].n_turns == len(said) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_control_strings_never_stand_inside_a_turn():
    for text in ("<|im_end|>", "<\\|im_end|>", "<<||", "<\\\\|a<|", "", "a<", "|b"):
        safe = C.escaped(pa.array([text]))[0].as_py()
        assert not re.search(r"<\|", safe) and C.unescaped(safe) == text
        role = C.escaped_roles(pa.array([text + "\nx"]))[0].as_py()
        assert "\n" not in role and "<" not in role and C.unescaped_role(role) == text + "\nx"


def test_assembly_and_no_turns(spark):
    data, at, start, size = C.assembled(pa.array(["user", ""]), pa.array(["hé", ""]))
    assert bytes(data).decode() == "<|im_start|>user\nhé<|im_end|>\n<|im_start|>\n<|im_end|>\n"
    assert bytes(data[start[0]:start[0] + size[0]]).decode() == "hé" and at[-1] == len(data)
    assert C.formatted(spark.createDataFrame([], SCHEMA)).collect() == []
