"""Personal data: base spans against plain expressions, terms against brute-force counts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from costlens.llm import pii as P

SCHEMA = "doc_id long, text string, base string"
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        n = [int(c) for c in d[::-1]]
        return 14 <= len(d) <= 19 and (sum(n[::2]) + sum(sum(divmod(2 * x, 10)) for x in n[1::2])) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base(text):
    return [(m.start(), rank, m.end(), kind, m[0]) for rank, (kind, rx) in enumerate(PLAIN.items())
            for m in rx.finditer(text or "") if ok(kind, m[0])]


def join(spans):
    return ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in sorted(spans))


def least_share(k, n):
    z2, p = P.Z ** 2, k / n
    return (p + z2 / (2 * n) - P.Z * math.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)


def brute(rows):
    terms = lambda t: set(re.findall(r"[^\W_]{3,}", (t or "").lower()))
    df_e, df_t, joint, texts = Counter(), Counter(), Counter(), {t or "" for _, t, _ in rows}
    for t in texts:
        es, ts = {f"{s[3]}:{s[4]}" for s in base(t)}, terms(t)
        df_e.update(es)
        df_t.update(ts)
        joint.update((e, x) for e in es for x in ts)
    telling = defaultdict(dict)
    for (e, x), k in joint.items():
        hidden = -math.log2(least_share(k, df_t[x]))
        if hidden <= P.GENERALISE and df_e[e] < len(texts):
            telling[e][x] = hidden <= P.REMOVE
    out = []
    for i, t, _ in rows:
        found = base(t)
        here = defaultdict(bool)
        for s in found:
            for x, r in telling.get(f"{s[3]}:{s[4]}", {}).items():
                here[x] |= r
        more = [(m.start(), 5 + here[m[0].lower()], m.end(), "removed_term" if here[m[0].lower()] else "general_term")
                for m in re.finditer(r"[^\W_]{3,}", t or "") if m[0].lower() in here
                and not any(m.start() < s[2] and s[0] < m.end() for s in found)]
        counts = [sum(s[3] == k for s in found) for k in P.KINDS]
        out.append((i, *counts, hashlib.sha256(join(found).encode()).hexdigest(), join(found + more)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(8)
    bits = ["a.b+c@x-y.co.uk", "a@b", "@", "a@b.c@d.e", "x@y.z_q@r.st", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.004",
            "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "378282246310005", "+1 (415) 555-0100", "+49", "+1..2",
            "+12345678901234567", " ", ".", "-", "é", "😀", "\n", "word", "7", "12", "(", "%"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14))), "b") for i in range(500)]
    for i in range(500, 540):  # one address beside its owner's rare name, and beside common words
        who = "owner@corp.example" if i % 2 else ""
        rows.append((i, f"{'Zebulon' if i % 2 or i == 510 else 'Anna'} wrote word {i} {'Quillfeather' if i % 2 else ''} {who}", ""))
    rows += [(600, "Copycat only@copies.example Singular", "")] * 9
    rows += [(601, None, None), (602, "", ""), (None, "owner@corp.example Zebulon", ""), (603, "9" * 60_000, ""),
             (604, "4 " * 20_000, ""), (605, "a" * 60_000, ""), (606, "1.2.3.4 " * 2_000, "")]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    out = P.personal_data(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got, want = sorted((tuple(r) for r in out.collect()), key=repr), brute(rows)
    assert any("removed_term" in r[-1] for r in want)
    assert got == want


def test_sanitised_text(spark):
    rows = [(1, "é mail a@b.cd, +1 (415) 555-0100!", "x", 5), (2, None, None, None), (3, "clean text", "y", 10),
            (4, "4111 1111 1111 1111@x.com end", "", 0), (None, "1.2.3.4", "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, KEY string, n_chars long")
    out = P.sanitised(df)
    assert out.columns == df.columns
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([
        (1, "é mail [EMAIL], [PHONE]!", "x", 24), rows[1], rows[2], (4, "[CARD] end", "", 10), (None, "[IP]", "z", 4)], key=repr)
    assert P.sanitised(df.limit(0)).count() == 0 and P.personal_data(df.limit(0)).count() == 0


def planted(rng, owners, decoys, other):
    """Owners' rare names beside their address, among words that are common, that stand there once, or beside many addresses.

    Half of the owners write often enough to be given away by their name.
    """
    vocab = [f"word{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    rows, names = [], {}
    for o in range(owners):
        times = 24 if o % 2 else 2
        names[f"name{o}"] = times > 3
        rows += [f"{say(20)} Name{o} wrote {say(5)} hapax{o}x{i} office{o % 3} o{o}@corp.example" for i in range(times)]
    rows += [f"{say(20)} office{i % 3} Decoy{i} d{i}@other.example" for i in range(decoys)]
    rows += [f"{say(30)} plain{i}" for i in range(other)]
    rng.shuffle(rows)
    return [(i, t, "") for i, t in enumerate(rows)], names


def told(spark, rows):
    out = P.personal_data(spark.createDataFrame(rows, SCHEMA))
    text = dict((i, t) for i, t, _ in rows)
    found = set()
    for r in out.collect():
        for kind, a, b in (x.rsplit(":", 2) for x in r["spans"].split(",") if x):
            if kind.endswith("_term"):
                found.add((text[r["doc_id"]][int(a):int(b)].lower(), kind))
    return found


def test_planted_names_are_told_from_decoys_at_any_corpus_size(spark):
    rows, names = planted(random.Random(5), 20, 60, 300)
    more = rows + [(10_000 + i, f"unrelated text {i} of something else entirely", "") for i in range(4_000)]
    small, large = told(spark, rows), told(spark, more)
    assert small == large                                              # unrelated texts change no verdict
    terms = {t for t, _ in small}
    wanted = {n for n, often in names.items() if often}
    assert wanted <= terms                                             # recall 1
    assert len(wanted) / len(terms) >= 0.9                             # precision
    assert {k for t, k in small if t in wanted} == {"removed_term"}
    assert not {t for t in terms if t.startswith(("hapax", "decoy", "plain", "word", "office"))}


def test_support_grows_from_nothing_to_removal(spark):
    texts = [f"Always{n} n{n}x{i} a{n}@b.example" for n in (1, 3, 4, 14, 15) for i in range(n)]
    rows = [(i, t, "") for i, t in enumerate(texts)] + [(900, "other words", "")]
    rows += [(1000 + i, "Copied c@b.example", "") for i in range(30)]        # one text, however often
    assert {x for x in told(spark, rows) if x[0].startswith(("always", "copied"))} == {
        ("always4", "general_term"), ("always14", "general_term"), ("always15", "removed_term")}
