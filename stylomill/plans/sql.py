"""Pieces of SQL that the comparison queries share."""

BLANKS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: One row per document: its latest delivery.
CORPUS = "corpus AS (SELECT id, author, genre, text FROM docs WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)"


def words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '[^{BLANKS}]+')"


def n_words(text: str) -> str:
    return f"len({words(text)})"


def squash(text: str) -> str:
    return f"array_to_string({words(text)}, ' ')"


def hash_order(seed: int, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', " + ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys) + "))"


def hash_uniform(seed: int, *keys: str) -> str:
    return f"(('0x' || substr({hash_order(seed, *keys)}, 1, 8))::BIGINT / 4294967296.0)"


def length_bin(n: str, edges: tuple = (200, 400, 800)) -> str:
    low = (0, *edges)
    return "CASE " + " ".join(f"WHEN {n} < {b} THEN '{a}-{b - 1}'" for a, b in zip(low, edges)) + f" ELSE '{edges[-1]}+' END"
