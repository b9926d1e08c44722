"""Small tables with all that may go wrong in them."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, size string, `key` int, n_tokens string, score string, block int"
SYLLABLES = {"en": "the er on an re he in ed nd ha".split(), "de": "ein sch der ung ich ß ü ver zu st".split(), "fr": "eau oi é le que ou è ment ai re".split()}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(n: int = 60, seed: int = 3) -> list[tuple]:
    """Ordinary documents, exact and near copies, then odd ones: null and empty texts, blanks only, null ids, repeated rows and ids, a long one."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((k, sentence(rng, lang, rng.randint(12, 90)), lang, f"s{k % 5}"))
    for k in range(n, n + 12):
        source = rows[k - n]
        parts = source[1].split(" ")
        if k % 3:
            parts[rng.randrange(len(parts))] = "changed"
        rows.append((k, " ".join(parts), source[2], "s0"))
    long = sentence(rng, "en", 60_000)
    rows += [(900, None, None, None), (901, "", "en", ""), (902, " \t\n\x0b\x0c\r ", "de", "s1"), (903, "one", "en", "s2"), (904, "123 ### !!!", None, "s2")]
    rows += [(905, long, "en", "s3"), (906, "same words here", "en", None), (906, "same words here", "en", None), (907, "a b c", "fr", "s4"), (907, "quite another text", "en", "s4")]
    rows += [(None, "no id at all", "en", "s1"), (None, "no id at all", "en", "s1"), (None, None, None, None), (908, "ÉİΣς 日本 👍🏽 <|endoftext|> x", "en", "é")]
    return [(*row, len(row[1] or ""), True, "clash", 7, "clash", "clash", 1) for row in rows]


def by_id(frame) -> dict:
    return {row.doc_id: row for row in frame.collect()}
