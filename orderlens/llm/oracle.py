"""What the text operators must return, as SQL on the sample tables."""

from __future__ import annotations

from orderlens.llm.license_scan import (
    TEMPLATES,
    THRESHOLD,
    anchor_places,
    every_template,
    template_bigrams,
    template_numbers,
    template_words,
    window_lengths,
)
from orderlens.llm.sharding import Shard, default_tree

_SPACES = r"[\x20\x09-\x0D]+"

EXACT_DEDUP = rf"""
SELECT doc_id,
       first_value(doc_id) OVER same AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER same = 1 AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm ORDER BY doc_id)
"""

# Weights 3, 1, 2 in turn; 1.5 times all words; at most twice a source; seed 7.
MIXING = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
    FROM documents
),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
    FROM sized GROUP BY source
),
weighed AS (
    SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS most FROM sources
),
levels AS (
    SELECT *, most / weight AS tightness,
        (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(most) OVER before AS BIGINT), 0))
            / (CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER before AS BIGINT), 0)) AS level
    FROM weighed
    WINDOW before AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
open_level AS (
    SELECT level AS common FROM levels WHERE tightness > level ORDER BY tightness, rank LIMIT 1
),
goals AS (
    SELECT source, source_size,
        coalesce(least(CAST(most AS DOUBLE), (SELECT common FROM open_level) * weight), CAST(most AS DOUBLE)) AS target,
        CAST(('0x' || substr(md5('7|offset|' || coalesce('=' || source, 'null')), 1, 12)) AS BIGINT) % 16777216 AS start
    FROM levels
),
parts AS (
    SELECT *, CAST(floor(ln(size + 1) * 16) AS INTEGER) AS size_class,
        CAST(('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT) AS dealt
    FROM sized
),
numbered AS (
    SELECT p.*, row_number() OVER (
        PARTITION BY source ORDER BY size_class, dealt % n_parts, size, doc_id NULLS LAST) AS rank
    FROM (
        SELECT *, CAST(ceil(count(*) OVER (PARTITION BY source, size_class) / 20000) AS BIGINT) AS n_parts FROM parts
    ) p
),
mixed AS (
    SELECT doc_id, size, source_size, target, rank, start,
        CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 16777216) AS BIGINT) ELSE 0 END AS rate
    FROM numbered n JOIN goals g ON n.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
    (((rank * rate + start) >> 24) - (((rank - 1) * rate + start) >> 24)) * size AS taken
FROM mixed
"""



_EVERY = every_template(TEMPLATES)


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"


_TEMPLATES = ", ".join(
    f"({at}, '{name}', {_list(template_bigrams(text))}, {_list(template_numbers(text))})"
    for at, (name, text) in enumerate(_EVERY)
)
_PLACES = ", ".join(
    f"({at}, '{bigram}', {place}, {length})"
    for at, (_, text) in enumerate(_EVERY)
    for bigram, place in anchor_places(text, THRESHOLD)
    for length in window_lengths(len(template_words(text)))
)

# Neither documents nor templates are left out by anchors or sizes.
LICENSE_SCAN = rf"""
WITH RECURSIVE marked AS (
    SELECT row_number() OVER () AS r, doc_id, [x FOR x IN string_split_regex(lower(
        regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), chr(1) || chr(2), '  '),
            '\n(?:[\x20\x09\x0B-\x0D]*\n)+', ' ' || chr(2) || ' ', 'g'),
            '([.!?])[\x20\x09-\x0D]+', '\1 ' || chr(1) || ' ', 'g'),
            '\n', ' ' || chr(1) || ' ', 'g')), '[^a-z0-9\x01\x02]+') IF x <> ''] AS t
    FROM documents
),
texts AS (
    SELECT r, doc_id, [x FOR x IN t IF x <> chr(1) AND x <> chr(2)] AS w FROM marked
),
marks AS (
    SELECT r, x, i - row_number() OVER (PARTITION BY r ORDER BY i) AS cut
    FROM (SELECT r, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM marked) WHERE x IN (chr(1), chr(2))
),
cuts AS (
    SELECT r, 'line' AS kind, cut FROM marks
    UNION SELECT r, 'paragraph', cut FROM marks WHERE x = chr(2)
    UNION SELECT r, kind, edge FROM texts, (VALUES ('line'), ('paragraph'), ('whole')) AS k(kind),
        (VALUES (true), (false)) AS e(first), LATERAL (SELECT CASE WHEN first THEN 0 ELSE len(w) END AS edge)
),
ranges AS (
    SELECT DISTINCT r, cut AS first, following AS last
    FROM (SELECT r, cut, lead(cut) OVER (PARTITION BY r, kind ORDER BY cut) AS following FROM cuts)
    WHERE following > cut + 1
),
places(template, bigram, place, length) AS (VALUES {_PLACES}),
templates(template, license, bigrams, numbers) AS (VALUES {_TEMPLATES}),
bigrams AS (
    SELECT r, x || ' ' || lead(x) OVER (PARTITION BY r ORDER BY i) AS bigram, i - 1 AS spot
    FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM texts)
),
candidates AS (
    SELECT r, first, last, template FROM ranges, templates
    UNION
    SELECT r, greatest(spot - place, 0), least(spot - place + length, len(w)), template
    FROM bigrams JOIN places USING (bigram) JOIN texts USING (r)
),
spans AS (
    SELECT r, first, last, words, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) AS own
    FROM (
        SELECT r, first, last, w[first + 1 : last] AS words
        FROM (SELECT DISTINCT r, first, last FROM candidates) JOIN texts USING (r)
    )
),
counted AS (
    SELECT r, first, last, license, len(list_intersect(own, bigrams)) AS common, len(own) + len(bigrams) AS sizes
    FROM candidates JOIN spans USING (r, first, last) JOIN templates USING (template)
    WHERE list_has_all(words, numbers)
),
hits AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY common DESC, dice DESC, license, first, last) AS k
    FROM (SELECT r, first, last, license, common, common * 2.0::DOUBLE / sizes AS dice FROM counted)
    WHERE dice >= 0.8
),
sweep AS (
    SELECT r, k, [{{'first': first, 'last': last, 'license': license, 'dice': dice}}] AS kept FROM hits WHERE k = 1
    UNION ALL
    SELECT r, h.k, CASE WHEN len([x FOR x IN kept IF x.first < h.last AND h.first < x.last]) > 0 THEN kept
        ELSE list_append(kept, {{'first': h.first, 'last': h.last, 'license': h.license, 'dice': h.dice}}) END
    FROM sweep s JOIN hits h USING (r) WHERE h.k = s.k + 1
),
best AS (
    SELECT doc_id, notice.license AS license, notice.dice AS dice
    FROM (SELECT r, unnest(max_by(kept, k)) AS notice FROM sweep GROUP BY r) JOIN texts USING (r)
)
SELECT doc_id, license, count(*) AS n_spans, round(max(dice), 6) AS best_dice FROM best GROUP BY doc_id, license
"""



def _tree(tree: list[Shard]) -> str:
    """Each child of each node: the node's path, the child's path and number, and the weight below it."""
    below: dict[tuple[str, str, int], float] = {}
    for s in tree:
        region = f"/region {s.region}"
        rack = f"{region}/rack {s.rack}"
        for key in (("", region, s.region), (region, rack, s.rack), (rack, f"{rack}/shard {s.shard}", s.shard)):
            below[key] = below.get(key, 0.0) + s.weight
    return ", ".join(f"('{parent}', '{path}', {child}, {weight}::DOUBLE)" for (parent, path, child), weight in below.items())


def _descended(name: str, tree: list[Shard]) -> str:
    """(key, shard) by going down the tree level by level."""
    draw = "-ln((CAST(('0x' || substr(md5(path || '|' || key), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656) / weight"
    levels = []
    for level in range(3):
        parent = "''" if level == 0 else "d.path"
        source = "keys AS d" if level == 0 else f"{name}_{level - 1} AS d"
        levels.append(
            f"{name}_{level} AS (SELECT key, arg_min(t.path, (draw, child)) AS path, arg_min(child, (draw, child)) AS shard "
            f"FROM (SELECT key, t.path, child, {draw.replace('path', 't.path')} AS draw "
            f"FROM {source} JOIN {name}_tree t ON t.parent = {parent}) t GROUP BY key)"
        )
    return f"{name}_tree(parent, path, child, weight) AS (VALUES {_tree(tree)}),\n" + ",\n".join(levels)


SHARDING = rf"""
WITH crc_table AS (
    SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
        ORDER BY i) AS steps
    FROM (SELECT unnest(range(256)) AS i)
),
sized AS (
    SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, octet_length(encode(coalesce(text, ''))) + 1 AS size,
        xor(list_reduce([4294967295] || [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')],
            lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
    FROM documents, crc_table
),
keys AS (SELECT DISTINCT key FROM sized),
{_descended("now", default_tree(16))},
{_descended("grown", default_tree(17))},
dealt AS (
    SELECT s.*, now_2.shard AS shard, grown_2.shard AS grown_shard, CAST(('0x' || substr(md5(
        key || '|' || text_crc32 || '|' || size), 1, 12)) AS BIGINT)
        % greatest(64, (SELECT count(*) // 20000 FROM documents)) AS block
    FROM sized s JOIN now_2 USING (key) JOIN grown_2 USING (key)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law,
    CAST(shard AS INTEGER) AS shard, CAST(grown_shard AS INTEGER) AS grown_shard,
    row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM dealt
"""


def llm_oracle() -> dict[str, str]:
    return {
        "op2_exact_dedup": EXACT_DEDUP,
        "op3_license_scan": LICENSE_SCAN,
        "op8_mixing": MIXING,
        "op10_sharding": SHARDING,
    }
