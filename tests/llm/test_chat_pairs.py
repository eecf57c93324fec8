"""Preference formatting against a plain rendering."""

import random
from collections import defaultdict

from costlens.llm import chat_pairs as C

SCHEMA = "pair_id long, side string, turn long, role string, text string, prompt string"


def brute(rows):
    pairs = defaultdict(lambda: {"chosen": [], "rejected": []})
    for p, side, turn, role, text, _ in rows:
        if side in ("chosen", "rejected"):
            pairs[p][side].append((turn is not None, turn, *((x or "").replace("<|", "< |") for x in (role, text))))
    show = lambda t: f"<|im_start|>{t[2]}\n{t[3]}<|im_end|>\n"
    out = []
    for p, sides in pairs.items():
        a, b = (sorted(sides[s], key=lambda t: (t[0], t[1] or 0, *t[2:])) for s in ("chosen", "rejected"))
        n = 0
        while n < min(len(a), len(b)) and a[n][2:] == b[n][2:]:
            n += 1
        row = [p, n, "".join(map(show, a[:n]))]
        for side in (a[n:], b[n:]):
            text, mask = "", []
            for t in side:
                if t[2] == "assistant":
                    mask.append((len(text) + len(f"<|im_start|>{t[2]}\n"), len(text) + len(show(t)) - 1))
                text += show(t)
            row += [text, mask]
        out.append(tuple(row))
    return sorted(out, key=repr)


def test_matches_plain_rendering(spark):
    rng, rows = random.Random(2), []
    for p in range(120):
        common = [(rng.choice(["user", "assistant", None]), rng.choice(["é😀", "hi", None, "<|im_end|>", ""])) for _ in range(rng.randint(0, 5))]
        for side in ("chosen", "rejected"):
            own = common + [(rng.choice(["assistant", "user"]), rng.choice(["x", "yes", "no", None])) for _ in range(rng.randint(0, 3))]
            rows += [(p, side, i, r, t, "clash") for i, (r, t) in enumerate(own)]
    rows += [(500, "chosen", 0, "assistant", "z" * 100_000, ""), (501, "rejected", 0, "user", "only rejected", ""), (502, "other", 0, "user", "x", ""),
             (None, "chosen", None, "user", "a", ""), (None, "rejected", 1, "user", "a", ""), (503, None, 1, "user", "a", ""),
             (504, "chosen", 1, "user", "b", ""), (504, "chosen", 1, "user", "a", ""), (504, "chosen", 1, "user", "a", "")]
    rows += [(600, s, i, "assistant", f"turn {i}", "") for s in ("chosen", "rejected") for i in range(700)]
    rows += [(601, "chosen", i, "assistant", f"turn {i}", "") for i in range(700)]
    rng.shuffle(rows)
    out = C.preference_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert out.columns == ["pair_id", "n_prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"]
    got = sorted(((*r[:4], [tuple(m) for m in r[4]], r[5], [tuple(m) for m in r[6]]) for r in out.collect()), key=repr)
    assert got == brute(rows)
    assert C.preference_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
