import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, shard string, words string"


def documents(spark, rows, schema=SCHEMA):
    """rows: (doc_id, text, lang, source); the columns that follow clash with names that the operators use."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "k", "s", "w") for r in rows], schema)


def corpus(seed=3, n=60):
    """Small texts with copies, near copies, shared passages, repeated lines, nulls and empty texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, base = some(60), some(120)
    rows = []
    for i in range(n):
        w = some(rng.randint(1, 150))
        if i % 5 == 1:
            w = w[:20] + passage + w[20:40]
        if i % 5 == 2:
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if i % 11 == 3:
            w = (some(9) * 6)[: rng.randint(10, 54)]
        text = " ".join(w) if i % 3 else "\n".join(" ".join(w[k : k + 8]) for k in range(0, len(w), 8))
        rows.append((i, text, "en", f"src{i % 3}" if i % 7 else None))
    rows += [(n, None, None, None), (n + 1, "", "en", "src0"), (n + 2, " \n\t ", "de", "src1"), (n + 3, rows[0][1], "en", "src0"), (n + 4, rows[0][1], "en", "src9")]
    rows += [(n + 5, " ".join(base * 40), "en", "src0"), (n + 6, "#x# " * 50, "en", "src2")]
    return rows
