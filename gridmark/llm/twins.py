"""SQL twins that are put together from parts."""

from __future__ import annotations


def crc32(number: str) -> str:
    """crc32 of a number's decimal digits, bit by bit."""
    return f"""xor(4294967295::BIGINT, list_reduce(
      list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda crc, b: list_reduce(generate_series(1, 8),
        lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)),
      4294967295::BIGINT))"""


def _tree(name: str, depth: int) -> str:
    """Levels of the trees of `{name}0` (g, i, h): nodes `{name}k`, their runs `{name}rk`, roots `{name}top`."""
    parts = []
    for k in range(depth):
        parts.append(f"{name}n{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k})")
        parts.append(f"{name}r{k} AS (SELECT g, i // 16 AS run, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {name}n{k} GROUP BY g, i // 16)")
        parts.append(f"{name}{k + 1} AS (SELECT g, run AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{k})")
    return ",\n".join([*parts, f"{name}top AS (SELECT g, h FROM {name}{depth})"])


def _climb(rows: str, name: str, depth: int, out: str) -> str:
    """`{out}`: rows(g, i, folded, proof) after the levels of a tree."""
    parts, last = [], rows
    for k in range(depth):
        step = 16**k
        left = f"array_to_string(r.hs[1:(s.i // {step}) % 16], '')"
        right = f"array_to_string(r.hs[(s.i // {step}) % 16 + 2:], '')"
        here = out if k == depth - 1 else f"{out}{k}"
        parts.append(f"""{here} AS (SELECT s.* REPLACE (
          CASE WHEN r.n = 1 THEN s.folded ELSE sha256({left} || s.folded || {right}) END AS folded, s.proof || CASE WHEN r.n = 1 THEN '' ELSE {left} || {right} END AS proof)
          FROM {last} s JOIN {name}r{k} r ON s.g = r.g AND s.i // {16 * step} = r.run)""")
        last = here
    return ",\n".join(parts)


def merkle_manifest() -> str:
    def leaf(text: str) -> str:
        fields = ["doc_id", "source", "lang", "n_chars", text]
        return "sha256(" + " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, {leaf("text")} AS h,
         CASE WHEN {crc32("doc_id")} % 5 = 0 THEN {leaf(f"translate(text, '{upper}', '{upper.lower()}')")} END AS claimed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d
), t0 AS (SELECT g, i, h FROM placed),
{_tree("t", 5)},
u0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM ttop),
{_tree("u", 3)},
start AS (SELECT doc_id, h AS leaf, g, i, coalesce(claimed, h) AS folded, '' AS proof FROM placed),
{_climb("start", "t", 5, "climbed")},
start2 AS (
  SELECT c.* REPLACE ('' AS g, s.i AS i), s.h AS subroot FROM climbed c
  JOIN (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i FROM ttop) s ON c.g = s.g
),
{_climb("start2", "u", 3, "done")}
SELECT doc_id, leaf, subroot, (SELECT h FROM utop) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = (SELECT h FROM utop) AS verified
FROM done
"""


def collocations() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(text, '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p
), t AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), grams AS (
  SELECT lang, k, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT lang, k, phrase, f, cut, array_to_string(string_split(phrase, ' ')[:cut], ' ') AS x, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS y
  FROM f, (SELECT unnest([1, 2]) AS cut) WHERE cut < k
), s AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, cut, a.f AS l, b.f AS r,
         CAST((1000000::HUGEINT * c.f * c.f) // (a.f::HUGEINT * b.f) AS BIGINT) AS score
  FROM cuts c JOIN f a ON a.lang = c.lang AND a.phrase = c.x JOIN f b ON b.lang = c.lang AND b.phrase = c.y
), best AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), nested AS (
  SELECT lang, part, max(f) AS longer FROM (
    SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[:2], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS part FROM f WHERE k = 3
  ) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best b JOIN t ON t.lang = b.lang LEFT JOIN nested x ON x.lang = b.lang AND x.part = b.phrase
WHERE x.longer IS NULL OR 100 * x.longer < 50 * a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
