"""SQL twins of the training-text queries, for DuckDB.

Twins state the result, not the method: all pairs where the operators join on
segments, plain grouping where they encode dictionaries.
"""

from __future__ import annotations

#: Words of at least twelve in a row: the items' runs joined to the documents' runs.
P8 = """
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
ir AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
dr AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)
"""

#: Copies by letters and digits, for texts whose parts bear no labels the parts are one.
P5 = r"""
WITH r AS (SELECT row_id, replace(lower(description), 'ß', 'ss') AS d, coalesce(source_document, '') AS s FROM extracted_rows WHERE regexp_matches(description, '[^\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')),
o AS (SELECT regexp_extract(d, '^[^\p{L}\p{N}]*(\p{L}+[ \t]*(?::|[ \t][-–]|–)?)', 1) AS o FROM (SELECT DISTINCT replace(lower(description), 'ß', 'ss') AS d, description FROM extracted_rows WHERE description IS NOT NULL)),
n AS (SELECT regexp_extract(o, '^\p{L}+') AS word, count(*) AS n, sum(regexp_matches(o, '[:–-]$')::INT) AS named FROM o WHERE o <> '' GROUP BY 1),
labels AS (SELECT string_agg(word, '|' ORDER BY word) AS p FROM n WHERE named >= 2 AND named >= 0.2 * n),
m AS (SELECT row_id, s, d, p, regexp_matches(d, '^[^\p{L}\p{N}]*(' || p || ')([^\p{L}\p{N}]|$)') AS labelled FROM r, labels),
x AS (SELECT row_id, s, CASE WHEN labelled THEN
    regexp_replace(regexp_replace(regexp_replace(d, '(^[^\p{L}\p{N}]*|[;|/.•][^\p{L}\p{N}]*)(' || p || ')([^\p{L}\p{N}])', chr(1) || '\2\3', 'g'),
      '(\n[^\p{L}\p{N}]*)(' || p || ')(\s*:|\s+[-–]|\s\s)', chr(1) || '\2\3', 'g'), '[^\p{L}\p{N}\p{M}\x{01}]+', '', 'g')
    ELSE regexp_replace(d, '[^\p{L}\p{N}\p{M}]+', '', 'g') END AS t FROM m),
k AS (SELECT row_id, regexp_replace(replace(lower(s), 'ß', 'ss'), '[^\p{L}\p{N}\p{M}]+', '', 'g') AS s, array_to_string(list_sort(list_filter(string_split(t, chr(1)), lambda v: v <> '')), chr(1)) AS t FROM x),
g AS (SELECT row_id, min(row_id) OVER (PARTITION BY s, t) AS first_row_id FROM k)
SELECT first_row_id, row_id FROM g WHERE row_id <> first_row_id
"""

_FIELD = r"(?:author|due date|grade band|outcome ?\d*|school(?: name)?|strand|subject|unit(?: title)?|title|name|date|topic|teacher|class|course|level|domain|standard)(?: \d+)?"
_UNFILLED = "|".join([
    r"\{\{\s*[A-Za-z_][\w.]*(?:\s*\|[^{}\n]*)?\s*\}\}", r"\$\{[A-Za-z_][\w.]*\}", r"<%=?\s*[A-Za-z_][\w.]*\s*%>", r"\[\[\s*[A-Za-z_]\w*\s*\]\]", "%[A-Z][A-Z0-9_]{2,}%",
    "(?:^|[^#])#[A-Z][A-Z0-9_]{2,}#", r"\b__[A-Z][A-Z0-9_]*__", r"(?:^|[^\\\w}$])\{[a-z]\w{2,}\}", f"<(?i:{_FIELD})>", rf"«\s?(?i:{_FIELD})\s?»", r"\[(?:INSERT|ADD|ENTER) [^\]\n]+\]",
    rf"\[(?i:your|insert|add|enter) (?i:{_FIELD})\]", rf"\((?i:add|insert|enter|your) (?i:{_FIELD})\)", r"\bTODO:\s*\p{L}", r"\bX{4,}\b", r"\b[Pp]laceholder text for\b", r"\b[Ll]orem ipsum\b",
])


def _four(text: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({text}), '[^\\p{{L}}]+'), lambda w: length(w) >= 4))"


_LETTERS = r"list_filter(string_split_regex(template, '[^\p{L}]+'), lambda w: w <> '')"
#: Unfilled fields, answers in place of content by their share of bare documents, and words without information.
P9 = rf"""
WITH d AS (SELECT doc_id, text, coalesce(source, '') AS host, coalesce(subject, '') AS subject,
    list_filter(list_transform(string_split_regex(regexp_replace(lower(text), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'), ' ')), lambda s: regexp_matches(s, '\p{{L}}')) AS lines FROM documents WHERE text <> ''),
t AS (SELECT *, list_distinct(list_transform(lines, lambda s: regexp_replace(s, '[\w-]+(?:\.[\w-]+)+|\b[a-f]*[0-9]+[0-9a-f]*\b', '#', 'g'))) AS templates,
    {_four(r"regexp_replace(text, '^\s*#+[^\n]*', '')")} AS body, {_four(r"regexp_extract(text, '^\s*#+\s*([^\n]*)', 1)")} AS title, list_concat({_four("host")}, {_four("subject")}) AS named FROM d),
j AS (SELECT doc_id, host, templates, len(list_filter(templates, lambda s: regexp_matches(s, '\p{{L}}{{4}}.*?\P{{L}}.*?\p{{L}}{{4}}'))) <= 4 AND NOT list_has_any(body, list_concat(named, title)) AND NOT list_has_any(title, named) AS bare,
    regexp_matches(text, '{_UNFILLED}') OR len(list_filter(range(1, len(lines) - 1), lambda i: lines[i] = lines[i + 1] AND lines[i + 1] = lines[i + 2])) > 0 AS direct FROM t),
p AS (SELECT doc_id, host, bare, unnest(templates) AS template FROM j),
v AS (SELECT word, count(*) AS n, sum(bare::INT) AS bare FROM (SELECT bare, unnest(list_distinct({_LETTERS})) AS word FROM p) GROUP BY word),
likely AS (SELECT template FROM p GROUP BY template HAVING count(*) >= 3 AND count(DISTINCT host) >= 3 AND sum(bare::INT) * 5 >= count(*) AND regexp_matches(template, '\p{{L}}{{4}}.*?\P{{L}}.*?\p{{L}}{{4}}')),
answers AS (SELECT template FROM (SELECT template, unnest({_four("template")}) AS word FROM likely) JOIN v USING (word) GROUP BY template HAVING avg(v.bare / v.n) >= 0.1),
common AS (SELECT list(word) AS words FROM v WHERE n * 100 >= (SELECT count(*) FROM p)),
w AS (SELECT doc_id, template, {_LETTERS} AS ws FROM p),
alien AS (SELECT doc_id, template, ws FROM w, common WHERE len(ws) >= 4 AND words IS NOT NULL AND NOT list_has_any(ws, words)),
alone AS (SELECT word, count(*) AS alone FROM (SELECT unnest(list_distinct(ws)) AS word FROM alien) GROUP BY word),
dummy AS (SELECT word FROM alone JOIN v USING (word) WHERE alone * 100 >= (SELECT count(*) FROM alien) AND alone >= 0.8 * n AND n >= 3),
made AS (SELECT doc_id FROM (SELECT doc_id, template, len(ws) AS size, unnest(ws) AS word FROM alien) JOIN dummy USING (word) GROUP BY doc_id, template, size HAVING count(*) >= 0.8 * size)
SELECT doc_id FROM j WHERE direct UNION SELECT doc_id FROM p JOIN answers USING (template) UNION SELECT doc_id FROM w WHERE len(ws) >= 4 AND len(list_distinct(ws)) * 2 <= len(ws) UNION SELECT doc_id FROM made
"""

P5_RECORDS = P5[: P5.index("g AS (SELECT row_id")].rstrip().rstrip(",") + " SELECT min(row_id) AS first_row_id, count(*) AS copies FROM k GROUP BY s, t"

ORACLES = {"p8_found": P8, "p5_found": P5, "p5_records": P5_RECORDS, "p9_found": P9}
