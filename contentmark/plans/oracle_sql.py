"""DuckDB oracle SQL for the registered queries (run by the driver at sf0.01).

``NODE_CTES`` rebuilds the node / text tables from ``pages`` with a
recursive CTE written independently of the Spark shredder (regex
tokenisation + stack walk); each oracle appends its own CTEs and a final
SELECT.  Doubles are rounded to 6 places and arrays rendered as strings in
both engines so value hashes compare exactly.
"""

from __future__ import annotations

from contentmark.functions.text import WS_CLASS

WS = WS_CLASS + "+"

NODE_CTES = r"""
WITH RECURSIVE src AS (SELECT page_id, html FROM pages), toks AS (
  SELECT page_id, i, toks[i] AS tok,
         lower(regexp_extract(toks[i], '^<(/?[A-Za-z][A-Za-z0-9]*)', 1)) AS nm
  FROM (SELECT page_id, regexp_extract_all(html,
          '(?is)<!--.*?-->|<![^>]*>|<script[^>]*>|<style[^>]*>|var t="</p>";track\([0-9]+\);|<[^>]+>|[^<]+') AS toks
        FROM src), LATERAL (SELECT unnest(range(1, len(toks) + 1)) AS i)
), o AS (
  SELECT *, sum(opn) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS ord
  FROM (SELECT *, CASE WHEN nm = '' OR nm[1:1] = '/' THEN 0 ELSE 1 END AS opn FROM toks)
), walk AS (
  SELECT DISTINCT page_id, 0::BIGINT AS i, []::STRUCT(o BIGINT, t VARCHAR)[] AS st,
         NULL::BIGINT AS pre, NULL::BIGINT AS parent, []::BIGINT[] AS path, NULL::BIGINT AS txt_node FROM o
  UNION ALL
  SELECT o.page_id, o.i,
    CASE WHEN opn = 1 AND nm NOT IN ('br','meta') THEN list_append(st, {'o': o.ord::BIGINT, 't': nm})
         WHEN nm[1:1] = '/' AND len(list_filter(st, lambda x: x.t = nm[2:])) > 0
           THEN st[1:len(st) - list_position(list_reverse(list_transform(st, lambda x: x.t)), nm[2:])]
         ELSE st END,
    CASE WHEN opn = 1 THEN o.ord::BIGINT END,
    CASE WHEN opn = 1 THEN coalesce(st[len(st)].o, -1) END,
    CASE WHEN opn = 1 THEN list_append(list_transform(st, lambda x: x.o), o.ord::BIGINT) END,
    CASE WHEN nm = '' AND tok NOT LIKE '<!%' AND len(st) > 0 THEN st[len(st)].o END
  FROM walk JOIN o ON o.page_id = walk.page_id AND o.i = walk.i + 1
), texts AS (
  SELECT w.page_id, w.i, w.txt_node AS node,
    replace(replace(replace(replace(t.tok, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS text
  FROM walk w JOIN o t ON t.page_id = w.page_id AND t.i = w.i WHERE w.txt_node IS NOT NULL
), nodes AS (
  SELECT w.page_id, w.pre, w.parent, len(w.path) - 1 AS depth, o.nm AS tag, o.tok AS raw, w.path,
    coalesce((SELECT string_agg(x.text, '' ORDER BY x.i) FROM texts x
              WHERE x.page_id = w.page_id AND x.node = w.pre), '') AS own_text
  FROM walk w JOIN o ON o.page_id = w.page_id AND o.i = w.i WHERE w.pre IS NOT NULL
), tpath AS (
  SELECT t.*, n.path, n.tag FROM texts t JOIN nodes n ON n.page_id = t.page_id AND n.pre = t.node
)"""

# Normalise white space the way Python's ' '.join(s.split()) does.
def _norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


# Lowest common ancestor by counting: the deepest ancestor-or-self that all
# seeds of a page share (independent of the min/max-path form used in Spark).
LCA_BY_COUNT = """
  SELECT page_id, max(anc) AS lca FROM (
    SELECT s.page_id, a.anc, count(DISTINCT s.pre) AS k, any_value(c.n) AS n
    FROM {seeds} s, LATERAL (SELECT unnest(s.path) AS anc) a,
         (SELECT page_id, count(DISTINCT pre) AS n FROM {seeds} GROUP BY page_id) c
    WHERE c.page_id = s.page_id
    GROUP BY s.page_id, a.anc) WHERE k = n GROUP BY page_id"""

GOLD_CTES = rf"""
, doclines AS (
  SELECT doc_id, line_no, {_strip('line')} AS text, line
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no
        FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS lines FROM documents))
), cut AS (
  SELECT doc_id, min(line_no) AS c FROM doclines WHERE text = '!@#$%^&*()  COMMENTS' GROUP BY doc_id
), goldlines AS (
  SELECT d.doc_id, d.line_no, d.text FROM doclines d LEFT JOIN cut USING (doc_id)
  WHERE d.text <> '' AND (cut.c IS NULL OR d.line_no < cut.c)
), pagedoc AS (
  SELECT page_id, CAST(regexp_extract(url, '/[a-z]{{2}}/([0-9]+)', 1) AS BIGINT) AS doc_id
  FROM pages WHERE regexp_extract(url, '/[a-z]{{2}}/([0-9]+)', 1) <> ''
), gold AS (
  SELECT p.page_id, g.line_no, g.text FROM pagedoc p JOIN goldlines g USING (doc_id)
), hits AS (
  SELECT t.page_id, g.line_no, t.i, t.node, t.path
  FROM tpath t JOIN gold g ON g.page_id = t.page_id
   AND {_norm('t.text')} = {_norm('g.text')}
), owners AS (
  SELECT DISTINCT page_id, node AS pre, path FROM hits
), lca AS (""" + LCA_BY_COUNT.format(seeds="owners") + ")"


# The attribute-annotated corpus derived from pages (see queries.annotated_pages).
ANNOTATED_SRC = ("""SELECT page_id, replace(replace(replace(html, '<b>', '<span __boilernet_label="1">'),
  '<div class="ad">', '<div class="ad" __boilernet_label="0">'),
  '<br>', '<br __boilernet_label="0">') AS html FROM pages""")
ANNOTATED_CTES = NODE_CTES.replace("src AS (SELECT page_id, html FROM pages)",
                                   f"src AS ({ANNOTATED_SRC})")

# The single text run (".string") of each element that has one.
SINGLE_STRING = """
, kids AS (
  SELECT page_id, node, count(*) AS n FROM (
    SELECT page_id, parent AS node FROM nodes WHERE parent >= 0
    UNION ALL SELECT page_id, node FROM texts
    UNION ALL SELECT w.page_id, w.st[len(w.st)].o FROM walk w JOIN o ON o.page_id = w.page_id AND o.i = w.i
              WHERE o.tok LIKE '<!--%' AND len(w.st) > 0)
  GROUP BY page_id, node)
, sstr AS (
  SELECT t.page_id, t.node AS pre, t.i FROM texts t
  JOIN kids k ON k.page_id = t.page_id AND k.node = t.node WHERE k.n = 1
  UNION ALL
  SELECT s.page_id, n.parent, s.i FROM sstr s JOIN nodes n ON n.page_id = s.page_id AND n.pre = s.pre
  JOIN kids k ON k.page_id = n.page_id AND k.node = n.parent WHERE n.parent >= 0 AND k.n = 1)
"""

CLASS_VAL = """regexp_extract(raw, '\\sclass="([^"]*)"', 1)"""
HAS_CLASS = """regexp_matches(raw, '\\sclass="')"""


def _class_list(raw_val: str) -> str:
    return f"list_filter(string_split_regex(trim({raw_val}), '{WS}'), lambda x: x <> '')"


def node_oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["dom_nodes"] = NODE_CTES + """
SELECT page_id, pre::BIGINT AS pre, parent::BIGINT AS parent, depth::BIGINT AS depth, tag, own_text FROM nodes"""
    q["label_block_by_text"] = NODE_CTES + GOLD_CTES + """
SELECT n.page_id, n.pre::BIGINT AS pre, n.tag,
       CAST(coalesce(list_contains(n.path, l.lca), false) AS INTEGER) AS is_main
FROM nodes n LEFT JOIN lca l USING (page_id)"""
    q["gold_lines"] = NODE_CTES + GOLD_CTES + """
SELECT doc_id, line_no::BIGINT AS line_no, text FROM goldlines"""
    q["gold_keys"] = NODE_CTES + GOLD_CTES + """
SELECT page_id, line_no::BIGINT AS line_no, left(text, 50) AS key_raw,
       replace(left(text, 50), '"', '') AS key_own FROM gold"""
    q["gold_candidates"] = NODE_CTES + GOLD_CTES + """
SELECT DISTINCT g.page_id, g.line_no::BIGINT AS line_no, t.node::BIGINT AS pre
FROM tpath t JOIN gold g ON g.page_id = t.page_id
 AND (contains(t.text, left(g.text, 50)) OR contains(t.text, replace(left(g.text, 50), '"', '')))"""
    q["gold_align"] = NODE_CTES + GOLD_CTES + """
SELECT page_id, pre::BIGINT AS pre FROM owners"""
    q["label_by_text"] = NODE_CTES + GOLD_CTES + """
, os AS (SELECT page_id, list(pre) AS s FROM owners GROUP BY page_id)
SELECT n.page_id, n.pre::BIGINT AS pre,
       CAST(coalesce(len(list_intersect(n.path, os.s)) > 0, false) AS INTEGER) AS is_main
FROM nodes n LEFT JOIN os USING (page_id)"""
    q["class_select"] = NODE_CTES + f"""
SELECT page_id, pre::BIGINT AS pre, tag FROM nodes
WHERE {HAS_CLASS} AND list_contains({_class_list(CLASS_VAL)}, 'ad')"""
    q["attr_select"] = NODE_CTES + """
SELECT page_id, pre::BIGINT AS pre, tag FROM nodes
WHERE regexp_extract(raw, '\\slang="([^"]*)"', 1) = 'en' AND regexp_matches(raw, '\\slang="')"""
    q["subtree_mark"] = NODE_CTES + """
, s AS (SELECT page_id, list(pre) AS s FROM nodes WHERE tag = 'nav' GROUP BY page_id)
SELECT n.page_id, n.pre::BIGINT AS pre,
       CAST(coalesce(len(list_intersect(n.path, s.s)) > 0, false) AS INTEGER) AS is_main
FROM nodes n LEFT JOIN s USING (page_id)"""
    q["class_remove"] = NODE_CTES + f"""
SELECT page_id, pre::BIGINT AS pre,
       array_to_string(list_filter({_class_list(CLASS_VAL)}, lambda x: x <> 'ad'), ' ') AS classes
FROM nodes WHERE {HAS_CLASS}"""
    q["attr_remove"] = ANNOTATED_CTES + """
SELECT page_id, pre::BIGINT AS pre, tag, 0 AS has_label,
       (len(regexp_extract_all(raw, '\\s[^\\s=]+="[^"]*"'))
        - len(regexp_extract_all(raw, '\\s__boilernet_label="[01]"')))::BIGINT AS n_attrs
FROM nodes"""
    q["unwrap"] = NODE_CTES + """
, b AS (SELECT page_id, list(pre) AS bs FROM nodes WHERE tag = 'b' GROUP BY page_id)
, k AS (SELECT n.page_id, n.pre, n.tag,
               list_filter(n.path, lambda x: NOT list_contains(coalesce(b.bs, []), x)) AS np
        FROM nodes n LEFT JOIN b USING (page_id) WHERE n.tag <> 'b')
SELECT page_id, pre::BIGINT AS pre, coalesce(np[-2], -1)::BIGINT AS parent,
       (len(np) - 1)::BIGINT AS depth, tag FROM k"""
    pseeds = ", seeds AS (SELECT page_id, pre, path FROM nodes WHERE tag = 'p'), lca AS (" \
        + LCA_BY_COUNT.format(seeds="seeds") + ")"
    q["lca"] = NODE_CTES + pseeds + """
SELECT page_id, lca::BIGINT AS lca FROM lca"""
    q["block_mark"] = NODE_CTES + pseeds + """
SELECT n.page_id, n.pre::BIGINT AS pre,
       CAST(coalesce(list_contains(n.path, l.lca), false) AS INTEGER) AS is_main
FROM nodes n LEFT JOIN lca l USING (page_id)"""
    aseeds = (""", seeds AS (SELECT page_id, pre, path FROM nodes
                 WHERE regexp_matches(raw, '\\s__boilernet_label="1"')),
 lca AS (""" + LCA_BY_COUNT.format(seeds="seeds") + ")")
    q["contradictions"] = ANNOTATED_CTES + aseeds + """
SELECT n.page_id, count(*)::BIGINT AS n FROM nodes n JOIN lca l USING (page_id)
WHERE list_contains(n.path, l.lca) AND n.pre <> l.lca
  AND regexp_matches(n.raw, '\\s__boilernet_label="0"')
GROUP BY n.page_id"""
    q["own_text_search"] = NODE_CTES + """
SELECT DISTINCT page_id, node::BIGINT AS pre FROM texts WHERE contains(text, 'the')"""
    q["subtree_text"] = NODE_CTES + """
SELECT n.page_id, n.pre::BIGINT AS pre, coalesce(string_agg(t.text, '' ORDER BY t.i), '') AS subtree_text
FROM nodes n LEFT JOIN tpath t ON t.page_id = n.page_id AND list_contains(t.path, n.pre)
GROUP BY n.page_id, n.pre"""
    q["render"] = "SELECT page_id, html FROM pages"
    q["label_by_class"] = NODE_CTES + f"""
, s AS (SELECT page_id, list(pre) AS s FROM nodes
        WHERE {HAS_CLASS} AND list_contains({_class_list(CLASS_VAL)}, 'ad') GROUP BY page_id)
SELECT n.page_id, n.pre::BIGINT AS pre,
       CAST(coalesce(len(list_intersect(n.path, s.s)) > 0, false) AS INTEGER) AS is_main,
       CASE WHEN {HAS_CLASS.replace('raw', 'n.raw')}
            THEN array_to_string(list_filter({_class_list(CLASS_VAL.replace('raw', 'n.raw'))},
                                             lambda x: x <> 'ad'), ' ') ELSE '' END AS classes
FROM nodes n LEFT JOIN s USING (page_id)"""
    unwrap_tail = """
, sp AS (SELECT page_id, list(pre) AS ss FROM nodes WHERE tag = 'span' GROUP BY page_id)
, j AS (SELECT n.*, coalesce(sp.ss, []) AS ss FROM marked n LEFT JOIN sp USING (page_id))
, lifted AS (SELECT DISTINCT page_id,
               list_filter(path[1:len(path) - 1], lambda x: NOT list_contains(ss, x))[-1] AS pre
             FROM j WHERE tag = 'span' AND is_main = 1)
, k AS (SELECT j.page_id, j.pre, j.tag, j.is_main,
               list_filter(j.path, lambda x: NOT list_contains(j.ss, x)) AS np FROM j WHERE j.tag <> 'span')
SELECT k.page_id, k.pre::BIGINT AS pre, coalesce(k.np[-2], -1)::BIGINT AS parent,
       (len(k.np) - 1)::BIGINT AS depth, k.tag,
       CAST(k.is_main = 1 OR lf.pre IS NOT NULL AS INTEGER) AS is_main{extra}
FROM k LEFT JOIN lifted lf ON lf.page_id = k.page_id AND lf.pre = k.pre"""
    q["label_by_attr"] = ANNOTATED_CTES + """
, s AS (SELECT page_id, list(pre) AS s FROM nodes
        WHERE regexp_matches(raw, '\\s__boilernet_label="1"') GROUP BY page_id)
, marked AS (SELECT n.*, CAST(coalesce(len(list_intersect(n.path, s.s)) > 0, false) AS INTEGER) AS is_main
             FROM nodes n LEFT JOIN s USING (page_id))""" + unwrap_tail.format(extra=", 0 AS has_label")
    q["label_block_by_attr"] = ANNOTATED_CTES + aseeds + """
, marked AS (SELECT n.*, CAST(coalesce(list_contains(n.path, l.lca), false) AS INTEGER) AS is_main
             FROM nodes n LEFT JOIN lca l USING (page_id))""" + unwrap_tail.format(extra="")
    q["label_corpus"] = NODE_CTES + GOLD_CTES + """
, mainstart AS (SELECT w.page_id, w.i FROM walk w JOIN nodes n ON n.page_id = w.page_id AND n.pre = w.pre
                JOIN lca l ON l.page_id = n.page_id WHERE list_contains(n.path, l.lca))
SELECT o.page_id, string_agg(CASE WHEN m.i IS NOT NULL
         THEN regexp_replace(o.tok, '(/?>)$', ' CASM_main_content_label="1"\\1') ELSE o.tok END,
         '' ORDER BY o.i) AS html
FROM o LEFT JOIN mainstart m ON m.page_id = o.page_id AND m.i = o.i GROUP BY o.page_id"""
    for name in ("attr", "block_attr"):
        labelled = q["label_by_attr" if name == "attr" else "label_block_by_attr"]
        cut = labelled.rindex("\nSELECT ")
        q[f"label_corpus_{name}"] = labelled[:cut] + "\n, lab AS (" + labelled[cut:] + ")" + SINGLE_STRING + f"""
, trims AS (SELECT DISTINCT s.page_id, s.i, {_strip('t.text')} AS text FROM sstr s
            JOIN nodes n ON n.page_id = s.page_id AND n.pre = s.pre AND n.tag = 'span'
            JOIN texts t ON t.page_id = s.page_id AND t.i = s.i WHERE {_strip('t.text')} <> t.text)
SELECT o.page_id, string_agg(CASE
         WHEN m.i IS NOT NULL THEN replace(replace(replace(m.text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
         WHEN w.pre IS NULL THEN o.tok WHEN o.nm = 'span' THEN ''
         ELSE regexp_replace(regexp_replace(o.tok, ' __boilernet_label="[01]"', ''), '(/?>)$',
                CASE WHEN b.is_main = 1 THEN ' CASM_main_content_label="1"\\1' ELSE '\\1' END) END,
         '' ORDER BY o.i) AS html
FROM o JOIN walk w ON w.page_id = o.page_id AND w.i = o.i
LEFT JOIN lab b ON b.page_id = w.page_id AND b.pre = w.pre
LEFT JOIN trims m ON m.page_id = o.page_id AND m.i = o.i GROUP BY o.page_id"""
    q["page_scan"] = "SELECT page_id, url, length(html)::BIGINT AS n_chars FROM pages"
    q["gold_files"] = q["gold_lines"]
    q["page_files"] = """SELECT page_id, coalesce(html, '') AS html FROM pages
UNION ALL SELECT -1 - page_id, '' FROM pages"""
    q["csv_roundtrip"] = "SELECT page_id, html FROM pages"
    q["page_allowlist"] = """SELECT page_id, url FROM pages
WHERE contains(url, '/en/') OR contains(url, '/de/')"""
    return q


# --- blocks ---------------------------------------------------------------------------

def _semmap_values() -> str:
    from contentmark.functions.tags import SEMANTIC_NAME_TAG_MAP
    rows = ", ".join(f"('{t}', '{n}')" for n, t in SEMANTIC_NAME_TAG_MAP.items())
    return f"(VALUES {rows})"


def _class_str(raw: str) -> str:
    return (f"CASE WHEN regexp_matches({raw}, '\\sclass=\"') THEN array_to_string("
            f"{_class_list(CLASS_VAL.replace('raw', raw))}, ' ') ELSE '' END")


BLOCK_CTES = f"""
, semmap(tag, name) AS {_semmap_values()}
, body AS (SELECT page_id, min(pre) AS body FROM nodes WHERE tag = 'body' GROUP BY page_id)
, runs AS (
  SELECT page_id, node, list(t ORDER BY i) AS ts FROM (
    SELECT page_id, node, i, {_strip('text')} AS t FROM tpath WHERE tag NOT IN ('script', 'style'))
  WHERE t <> '' GROUP BY page_id, node)
, bl AS (
  SELECT n.page_id, n.pre, n.path, r.ts, b.body FROM nodes n
  JOIN runs r ON r.page_id = n.page_id AND r.node = n.pre
  JOIN body b ON b.page_id = n.page_id WHERE list_contains(n.path, b.body))
, steps AS (SELECT page_id, pre, body, unnest(path) AS anc FROM bl)
, named AS (
  SELECT s.page_id, s.pre, s.anc, coalesce(m.name, a.tag) AS tname, {_class_str('a.raw')} AS cls
  FROM steps s JOIN nodes a ON a.page_id = s.page_id AND a.pre = s.anc
  LEFT JOIN semmap m ON m.tag = a.tag WHERE s.anc >= s.body)
, seqs AS (
  SELECT page_id, pre, list(tname ORDER BY anc) AS tl,
         '[' || string_agg(tname, ', ' ORDER BY anc) || ']' AS tag_seq,
         '[' || coalesce(string_agg(cls, ', ' ORDER BY anc) FILTER (WHERE cls <> ''), '') || ']' AS class_seq
  FROM named GROUP BY page_id, pre)
, blocks AS (
  SELECT bl.page_id, 0::INTEGER AS part,
    (row_number() OVER (PARTITION BY bl.page_id ORDER BY bl.pre) - 1)::INTEGER AS pos,
    s.class_seq, s.tag_seq, '[' || array_to_string(bl.ts, ', ') || ']' AS text_seq,
    CAST(coalesce(list_contains(bl.path, l.lca), false) AS INTEGER) AS label, bl.pre AS node,
    s.tl, bl.ts
  FROM bl JOIN seqs s USING (page_id, pre) LEFT JOIN lca l USING (page_id))
"""

TOKEN_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def _vocab_ctes(size: int | None = None, learn: str = "true") -> str:
    return f"""
, vtoks AS (
  SELECT unnest(regexp_extract_all(lower(s), '{TOKEN_RE}')) AS token FROM (
    SELECT class_seq[2:-2] AS s FROM blocks WHERE {learn} UNION ALL SELECT tag_seq[2:-2] FROM blocks WHERE {learn}
    UNION ALL SELECT text_seq[2:-2] FROM blocks WHERE {learn}))
, vocab AS (
  SELECT token, (row_number() OVER (ORDER BY cnt DESC, token) + 3)::BIGINT AS id, cnt::BIGINT AS cnt
  FROM (SELECT token, count(*) AS cnt FROM vtoks GROUP BY token) ORDER BY cnt DESC, token{f' LIMIT {size}' if size else ''})
, vm AS (SELECT map(list(token), list(id)) AS m FROM vocab)"""


def _enc(col: str, length: int, pad: bool) -> str:
    ids = (f"list_transform(regexp_extract_all(lower({col}[2:-2]), '{TOKEN_RE}'), "
           f"lambda tk: coalesce(map_extract_value(vm.m, tk), 3))")
    full = f"list_concat([0], {ids}, [2])"
    trunc = f"CASE WHEN len({full}) > {length} THEN list_concat({full}[1:{length - 1}], [2]) ELSE {full} END"
    if pad:
        trunc = f"list_concat({trunc}, list_transform(range({length} - len({trunc})), lambda x: 1))"
    return trunc


def _split(n_blocks: int) -> str:
    return f"""
, sp AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM blocks)
, sp2 AS (SELECT *, (n + {n_blocks} - 1) // {n_blocks} AS k FROM sp)
, split AS (SELECT page_id, (pos * k // n)::INTEGER AS part,
                   (pos - ((pos * k // n) * n + k - 1) // k)::INTEGER AS pos, node, label,
                   class_seq, tag_seq, text_seq FROM sp2)"""


# Ids of whole texts over the whole vocabulary: token rows joined by token.
IDS_CTES = f"""
, tok3 AS (SELECT page_id, part, pos, 0 AS kind, regexp_extract_all(lower(class_seq[2:-2]), '{TOKEN_RE}') AS l FROM split
  UNION ALL SELECT page_id, part, pos, 1, regexp_extract_all(lower(tag_seq[2:-2]), '{TOKEN_RE}') FROM split
  UNION ALL SELECT page_id, part, pos, 2, regexp_extract_all(lower(text_seq[2:-2]), '{TOKEN_RE}') FROM split)
, tokrow AS (SELECT page_id, part, pos, kind, unnest(l) AS token, generate_subscripts(l, 1) AS k FROM tok3)
, idrow AS (SELECT t.page_id, t.part, t.pos, t.kind, list(v.id ORDER BY t.k) AS ids
            FROM tokrow t JOIN vocab v ON v.token = t.token GROUP BY t.page_id, t.part, t.pos, t.kind)
, eb AS (SELECT s.page_id, s.part, s.pos, any_value(s.label) AS label,
    list_concat([0], coalesce(any_value(ids) FILTER (kind = 0), []), [2]) AS class_ids,
    list_concat([0], coalesce(any_value(ids) FILTER (kind = 1), []), [2]) AS tag_ids,
    list_concat([0], coalesce(any_value(ids) FILTER (kind = 2), []), [2]) AS text_ids
  FROM split s LEFT JOIN idrow i ON i.page_id = s.page_id AND i.part = s.part AND i.pos = s.pos
  GROUP BY s.page_id, s.part, s.pos)"""


def block_oracles() -> dict[str, str]:
    base = NODE_CTES + GOLD_CTES + BLOCK_CTES
    q: dict[str, str] = {}
    q["text_blocks"] = base + """
SELECT page_id, part, pos, class_seq, tag_seq, text_seq, label FROM blocks"""
    q["blocks_csv"] = q["text_blocks"]
    parse = ", ".join(
        f"array_to_string(string_split(replace({c}[2:-2], ', ', ','), ','), '|') AS {c}"
        for c in ("class_seq", "tag_seq", "text_seq"))
    sizes = ", ".join(
        f"len(string_split(replace({c}[2:-2], ', ', ','), ','))::BIGINT AS n_{c}"
        for c in ("class_seq", "tag_seq", "text_seq"))
    q["parse_sequences"] = base + f"""
SELECT page_id, part, pos, {parse}, {sizes} FROM blocks"""
    q["vocab"] = base + _vocab_ctes(1000) + """
SELECT token, id, cnt FROM vocab"""
    enc = ", ".join(f"array_to_string({_enc(c, 64, False)}, ',') AS {i}" for c, i in
                    (("class_seq", "class_ids"), ("tag_seq", "tag_ids"), ("text_seq", "text_ids")))
    q["encode"] = base + _vocab_ctes(1000) + f"""
SELECT page_id, part, pos, {enc} FROM blocks, vm"""
    fill = "".join(f"""
, {i} || repeat(',1', 64 - len(string_split({i}, ',')))::VARCHAR AS {i}""" for i in ("class_ids", "tag_ids", "text_ids"))
    q["encode_padded"] = base + _vocab_ctes(1000) + f"""
, cut_ids AS (SELECT page_id, part, pos, {enc} FROM blocks, vm)
SELECT page_id, part, pos{fill} FROM cut_ids"""
    q["split_parts"] = base + _split(10) + """
SELECT page_id, part, pos, node::BIGINT AS node FROM split"""
    samples = base + _vocab_ctes() + _split(85) + IDS_CTES
    kinds = ("class_ids", "tag_ids", "text_ids")
    padded = ", ".join(
        f"string_agg(array_to_string(list_concat({k}, list_transform(range(l_{k} - len({k})), lambda x: 1)), ','), "
        f"'|' ORDER BY pos) AS {k}, any_value(l_{k}) AS l_{k}" for k in kinds)
    longest = ", ".join(f"max(len({k})) OVER (PARTITION BY page_id, part) AS l_{k}" for k in kinds)
    shown = " || ';' || ".join(
        f"{k} || repeat('|' || array_to_string(list_transform(range(l_{k}), lambda x: 1), ','), 85 - n::INT)" for k in kinds)
    q["fold_pad_mask"] = samples + f"""
, ln AS (SELECT *, {longest} FROM eb)
, sm AS (SELECT page_id, part, count(*) AS n, list(label ORDER BY pos) AS labels, {padded}
         FROM ln GROUP BY page_id, part)
SELECT page_id, part,
       array_to_string(list_concat(labels, list_transform(range(85 - n), lambda x: 0)), ',') AS labels,
       array_to_string(list_concat(list_transform(range(n), lambda x: 1),
                                   list_transform(range(85 - n), lambda x: 0)), ',') AS mask,
       md5({shown}) AS features_md5 FROM sm"""
    # text tokens, vectors from the ids beside them, and the blocks that pad a sample
    entry = "((((c % 1073741824 + 1) * {} % 4294967296) >> 16) % 3 - 1)"
    sums = ", ".join(f"sum({entry.format(2654435761 + 81006 * d)})::DOUBLE / any_value(n) AS d{d}" for d in range(4))
    vectors = samples + f"""
, tr AS MATERIALIZED (SELECT page_id, part, pos, unnest(text_ids)::BIGINT AS id,
                             generate_subscripts(text_ids, 1) AS k FROM eb)
, ctx AS (SELECT id, unnest([lag(id) OVER w, lead(id) OVER w]) AS c FROM tr
          WINDOW w AS (PARTITION BY page_id, part, pos ORDER BY k))
, vec AS MATERIALIZED (SELECT id, {sums} FROM ctx JOIN (SELECT id, count(*) AS n FROM tr GROUP BY id)
  USING (id) WHERE c IS NOT NULL GROUP BY id)
, padblock AS (SELECT page_id, part, unnest(range(count(*), 85)) AS pos FROM eb GROUP BY page_id, part)
"""
    for name, agg, empty in (("masked_mean", "sum(d{0}) / count(*)", "0.0"), ("masked_max", "max(d{0})", "-1e9")):
        q[name] = vectors + f"""
SELECT page_id, part, pos, {", ".join(f"round({agg.format(d)}, 6) AS d{d}" for d in range(4))}
FROM tr JOIN vec USING (id) GROUP BY page_id, part, pos
UNION ALL SELECT page_id, part, pos, {", ".join([f"{empty}::DOUBLE"] * 4)} FROM padblock"""
    q["unpad_explode"] = samples + """
SELECT page_id, part, pos, label, 1 AS mask, array_to_string(text_ids, ',') AS text_ids FROM eb"""
    return q



# --- vectors, model, evaluation ------------------------------------------------------

def _lse(x: str, y: str) -> str:
    m = f"greatest({x}, {y})"
    return f"({m} + ln(exp(({x}) - {m}) + exp(({y}) - {m})))"


EMB_LONG = """SELECT label, vec_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS dim,
  unnest(embedding)::DOUBLE AS x FROM embeddings"""

def _model_ctes(learn: str = "true") -> str:
    """Emissions and chain scores learned from the blocks that ``learn`` holds for."""
    return f"""
, eb AS (SELECT page_id, part, pos, label FROM split)
, rid AS (SELECT page_id, part, pos, label,
                 unnest(regexp_extract_all(lower(text_seq[2:-2]), '{TOKEN_RE}')) AS id FROM split)
, cnt AS (SELECT label, id, count(*) AS c FROM rid WHERE {learn} GROUP BY label, id)
, ntok AS (SELECT label, sum(c) AS n FROM cnt GROUP BY label)
, ndoc AS (SELECT label, count(*) AS n FROM eb WHERE {learn} GROUP BY label)
, prior AS (SELECT label, ln(n / sum(n) OVER ()) AS p FROM ndoc)
, lps AS (SELECT r.page_id, r.part, r.pos, y.label AS k,
                 sum(ln((coalesce(c.c, 0) + 1.0) / (nt.n + (SELECT count(*) + 4 FROM vocab)))) AS s
          FROM rid r CROSS JOIN (SELECT label FROM ndoc) y
          JOIN ntok nt ON nt.label = y.label
          LEFT JOIN cnt c ON c.label = y.label AND c.id = r.id
          GROUP BY r.page_id, r.part, r.pos, y.label)
, em AS (SELECT e.page_id, e.part, e.pos, e.label,
                (SELECT p FROM prior WHERE label = 0) + coalesce(l0.s, 0) AS s0,
                (SELECT p FROM prior WHERE label = 1) + coalesce(l1.s, 0) AS s1
         FROM eb e LEFT JOIN lps l0 ON l0.page_id = e.page_id AND l0.part = e.part AND l0.pos = e.pos AND l0.k = 0
                   LEFT JOIN lps l1 ON l1.page_id = e.page_id AND l1.part = e.part AND l1.pos = e.pos AND l1.k = 1)
, sq AS (SELECT page_id, part, pos, label,
                lead(label) OVER (PARTITION BY page_id, part ORDER BY pos) AS nxt FROM split WHERE {learn})
, tc AS (SELECT g.y, g.nxt, coalesce(c.c, 0) AS c FROM
           (SELECT a.y, b.nxt FROM (VALUES (0), (1)) a(y), (VALUES (0), (1)) b(nxt)) g
           LEFT JOIN (SELECT label AS y, nxt, count(*) AS c FROM sq WHERE nxt IS NOT NULL GROUP BY 1, 2) c
           ON c.y = g.y AND c.nxt = g.nxt)
, ec AS (SELECT kind, y, coalesce(c, 0) AS c FROM
           (SELECT k.kind, v.y FROM (VALUES ('start'), ('end')) k(kind), (VALUES (0), (1)) v(y)) g
           LEFT JOIN (SELECT 'start' AS kd, label AS yy, count(*) AS c FROM sq WHERE pos = 0 GROUP BY label
                      UNION ALL SELECT 'end', label, count(*) FROM sq WHERE nxt IS NULL GROUP BY label) x
           ON x.kd = g.kind AND x.yy = g.y)
, trans AS (
  SELECT 'trans' AS kind, y AS from_label, nxt AS to_label,
         ln((c + 1.0) / (sum(c) OVER (PARTITION BY y) + 2)) AS score FROM tc
  UNION ALL
  SELECT kind, -1, y, ln((c + 1.0) / (sum(c) OVER (PARTITION BY kind) + 2)) FROM ec)
, T AS (SELECT
    max(CASE WHEN kind = 'trans' AND from_label = 0 AND to_label = 0 THEN score END) AS t00,
    max(CASE WHEN kind = 'trans' AND from_label = 0 AND to_label = 1 THEN score END) AS t01,
    max(CASE WHEN kind = 'trans' AND from_label = 1 AND to_label = 0 THEN score END) AS t10,
    max(CASE WHEN kind = 'trans' AND from_label = 1 AND to_label = 1 THEN score END) AS t11,
    max(CASE WHEN kind = 'start' AND to_label = 0 THEN score END) AS st0,
    max(CASE WHEN kind = 'start' AND to_label = 1 THEN score END) AS st1,
    max(CASE WHEN kind = 'end' AND to_label = 0 THEN score END) AS en0,
    max(CASE WHEN kind = 'end' AND to_label = 1 THEN score END) AS en1 FROM trans)
, vit AS (
  SELECT e.page_id, e.part, e.pos, T.st0 + e.s0 AS a, T.st1 + e.s1 AS b, [0] AS pa, [1] AS pb
  FROM em e, T WHERE e.pos = 0
  UNION ALL
  SELECT e.page_id, e.part, e.pos,
    greatest(v.a + T.t00, v.b + T.t10) + e.s0, greatest(v.a + T.t01, v.b + T.t11) + e.s1,
    CASE WHEN v.a + T.t00 >= v.b + T.t10 THEN list_append(v.pa, 0) ELSE list_append(v.pb, 0) END,
    CASE WHEN v.a + T.t01 >= v.b + T.t11 THEN list_append(v.pa, 1) ELSE list_append(v.pb, 1) END
  FROM vit v JOIN em e ON e.page_id = v.page_id AND e.part = v.part AND e.pos = v.pos + 1, T)
, fw AS (
  SELECT e.page_id, e.part, e.pos, T.st0 + e.s0 AS a, T.st1 + e.s1 AS b FROM em e, T WHERE e.pos = 0
  UNION ALL
  SELECT e.page_id, e.part, e.pos, {_lse('v.a + T.t00', 'v.b + T.t10')} + e.s0,
         {_lse('v.a + T.t01', 'v.b + T.t11')} + e.s1
  FROM fw v JOIN em e ON e.page_id = v.page_id AND e.part = v.part AND e.pos = v.pos + 1, T)
"""

EVAL_CTES = """
WITH pr AS (SELECT quality AS label, toxic AS prediction FROM labels)
, pc AS (SELECT c AS cls,
    sum(CASE WHEN label = c AND prediction = c THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN label <> c AND prediction = c THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN label = c AND prediction <> c THEN 1 ELSE 0 END) AS fn
  FROM pr, (VALUES (0), (1)) v(c) GROUP BY c)
, pc2 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
                    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r, tp + fn AS sup FROM pc)
, pc3 AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM pc2)
"""


def model_oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["pool_mean"] = f"SELECT label, dim, round(avg(x), 6) AS value FROM ({EMB_LONG}) GROUP BY label, dim"
    q["pool_max"] = f"SELECT label, dim, round(max(x), 6) AS value FROM ({EMB_LONG}) GROUP BY label, dim"
    q["pool_first"] = f"""SELECT label, dim, round(arg_min(x, vec_id), 6) AS value
FROM ({EMB_LONG}) GROUP BY label, dim"""
    q["combine"] = f"""WITH l AS ({EMB_LONG})
, p AS (SELECT label, dim, avg(x) AS mn, max(x) AS mx, arg_min(x, vec_id) AS fs FROM l GROUP BY label, dim)
SELECT label, 'concat' AS how, dim, round(mn, 6) AS value FROM p
UNION ALL SELECT label, 'concat', dim + 64, round(mx, 6) FROM p
UNION ALL SELECT label, 'concat', dim + 128, round(fs, 6) FROM p
UNION ALL SELECT label, 'sum', dim, round(mn + mx + fs, 6) FROM p
UNION ALL SELECT label, 'mean', dim, round((mn + mx + fs) / 3, 6) FROM p
UNION ALL SELECT label, 'max', dim, round(greatest(greatest(mn, mx), fs), 6) FROM p"""
    q["context"] = """WITH c AS (SELECT vec_id, embedding,
    lag(embedding) OVER (PARTITION BY label, vec_id // 85 ORDER BY vec_id) AS pv,
    lead(embedding) OVER (PARTITION BY label, vec_id // 85 ORDER BY vec_id) AS nx FROM embeddings)
SELECT vec_id, (d - 1)::BIGINT AS dim, round(coalesce(pv[d], 0.0)::DOUBLE, 6) AS prev,
       round(coalesce(nx[d], 0.0)::DOUBLE, 6) AS next
FROM c, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS d)"""
    base = NODE_CTES + GOLD_CTES + BLOCK_CTES + _vocab_ctes()
    q["attention_mask"] = base + f"""
, n AS (SELECT page_id, part, pos, len(regexp_extract_all(lower(text_seq[2:-2]), '{TOKEN_RE}')) + 2 AS n FROM blocks)
SELECT page_id, part, pos, (SELECT max(n) FROM n)::BIGINT AS length, n::BIGINT AS n_real,
       CASE WHEN n < (SELECT max(n) FROM n) THEN n + 1 ELSE 0 END::BIGINT AS first_pad FROM n"""
    sb = base + _split(85)
    q["seq_len"] = sb + """
SELECT page_id, part, count(*)::BIGINT AS seq_len FROM split GROUP BY page_id, part"""
    q["class_weights"] = sb + """
, c AS (SELECT label, count(*) AS n FROM split GROUP BY label)
, s AS (SELECT count(*) AS n_s FROM (SELECT DISTINCT page_id, part FROM split))
, pc AS (SELECT label, n + CASE WHEN label = 0 THEN (SELECT 85 * n_s FROM s) - (SELECT count(*) FROM split)
                                ELSE 0 END AS n FROM c)
SELECT 'blocks' AS variant, label, n::BIGINT AS n,
       round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c
UNION ALL
SELECT 'padded', label, n::BIGINT, round(sum(n) OVER () / (count(*) OVER () * n), 6) FROM pc"""
    mb = sb + _model_ctes()
    q["emissions_nb"] = mb + """
SELECT page_id, part, pos, round(s0, 6) AS s0, round(s1, 6) AS s1 FROM em"""
    q["emissions_weighted"] = mb + """
, cw AS (SELECT label, ln(sum(count(*)) OVER () / (count(*) OVER () * count(*))) AS lw FROM split GROUP BY label)
SELECT page_id, part, pos, round(s0 + (SELECT lw FROM cw WHERE label = 0), 6) AS s0,
       round(s1 + (SELECT lw FROM cw WHERE label = 1), 6) AS s1 FROM em"""
    q["transitions"] = mb + """
SELECT kind, from_label, to_label, round(score, 6) AS score FROM trans"""
    q["decode"] = mb + """
, fin AS (SELECT v.page_id, v.part, arg_max(CASE WHEN v.a + T.en0 >= v.b + T.en1 THEN v.pa ELSE v.pb END,
                                           v.pos) AS path FROM vit v, T GROUP BY v.page_id, v.part)
SELECT page_id, part, (generate_subscripts(path, 1) - 1)::INTEGER AS pos, unnest(path) AS prediction FROM fin"""
    q["sequence_loss"] = mb + f"""
, z AS (SELECT f.page_id, f.part, arg_max({_lse('f.a + T.en0', 'f.b + T.en1')}, f.pos) AS logz,
               count(*) AS n FROM fw f, T GROUP BY f.page_id, f.part)
, gl AS (SELECT e.page_id, e.part, e.pos, e.label, lag(e.label) OVER (PARTITION BY e.page_id, e.part ORDER BY e.pos) AS pl,
                lead(e.label) OVER (PARTITION BY e.page_id, e.part ORDER BY e.pos) AS nl,
                CASE WHEN e.label = 0 THEN e.s0 ELSE e.s1 END AS es FROM em e)
, g AS (SELECT gl.page_id, gl.part, sum(gl.es
          + CASE WHEN gl.pl IS NULL THEN (CASE WHEN gl.label = 0 THEN T.st0 ELSE T.st1 END)
                 WHEN gl.pl = 0 THEN (CASE WHEN gl.label = 0 THEN T.t00 ELSE T.t01 END)
                 ELSE (CASE WHEN gl.label = 0 THEN T.t10 ELSE T.t11 END) END
          + CASE WHEN gl.nl IS NULL THEN (CASE WHEN gl.label = 0 THEN T.en0 ELSE T.en1 END) ELSE 0 END) AS gs
        FROM gl, T GROUP BY gl.page_id, gl.part)
SELECT round(sum(z.logz - g.gs) / sum(z.n), 6) AS loss, sum(z.n)::BIGINT AS n_blocks
FROM z JOIN g USING (page_id, part)"""
    own = ", ".join(f"list_transform(regexp_extract_all(lower({c}[2:-2]), '{TOKEN_RE}'), lambda x: '{m}:' || x)"
                    for c, m in (("class_seq", "c"), ("tag_seq", "g"), ("text_seq", "t")))
    slots = ", ".join(f"list_transform(coalesce({c}, []), lambda x: md5('{m}' || x)[1:4])"
                      for c, m in (("own", ""), ("before", "<"), ("after", ">")))
    # at the optimum of the fit, what the model gives a slot is what was observed
    q["fit_moments"] = base + _split(85) + f"""
, ow AS (SELECT page_id, part, pos, label, list_distinct(list_concat({own})) AS own FROM split)
, near AS (SELECT *, lag(own) OVER w AS before, lead(own) OVER w AS after FROM ow
           WINDOW w AS (PARTITION BY page_id, part ORDER BY pos))
, seen AS (SELECT label, list_distinct(list_concat({slots})) AS s FROM near)
, fl AS (SELECT label, ('0x' || unnest(s))::BIGINT AS slot FROM seen UNION ALL SELECT label, -1 FROM seen)
SELECT slot, count(*)::BIGINT AS n, sum(label)::DOUBLE AS observed, sum(label)::DOUBLE AS fitted FROM fl GROUP BY slot"""
    learn = "page_id % 5 > 1"
    q["split_metrics"] = NODE_CTES + GOLD_CTES + BLOCK_CTES + _vocab_ctes(learn=learn) + _split(85) + _model_ctes(learn) + """
, fin AS (SELECT v.page_id, v.part, arg_max(CASE WHEN v.a + T.en0 >= v.b + T.en1 THEN v.pa ELSE v.pb END,
                                           v.pos) AS path FROM vit v, T GROUP BY v.page_id, v.part)
, dp AS (SELECT page_id, part, (generate_subscripts(path, 1) - 1)::INTEGER AS pos, unnest(path) AS prediction FROM fin)
, pr AS (SELECT CASE page_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val_' ELSE 'train_' END AS sp, label, prediction
         FROM split JOIN dp USING (page_id, part, pos))
, tally AS (SELECT sp, c, count(*) FILTER (label = c AND prediction = c) AS tp,
    count(*) FILTER (label <> c AND prediction = c) AS fp, count(*) FILTER (label = c AND prediction <> c) AS fn
  FROM pr, (VALUES (0), (1)) v(c) GROUP BY sp, c)
, rates AS (SELECT *, tp + fn AS sup, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r,
                   coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM tally)
, wide AS (SELECT sp, sum(tp) / sum(tp + fp) AS precision_micro, sum(tp) / sum(tp + fn) AS recall_micro,
    2 * sum(tp) / sum(2 * tp + fp + fn) AS f1_micro, avg(p) AS precision_macro, avg(r) AS recall_macro, avg(f) AS f1_macro,
    sum(p * sup) / sum(sup) AS precision_weighted, sum(r * sup) / sum(sup) AS recall_weighted,
    sum(f * sup) / sum(sup) AS f1_weighted FROM rates GROUP BY sp)
SELECT sp || name AS metric, round(value, 6) AS value FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE sp) INTO NAME name VALUE value)"""
    q["eval_metrics"] = EVAL_CTES + """
, agg AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(sup) AS sup,
                 avg(p) AS pm, avg(r) AS rm, avg(f) AS fm,
                 sum(p * sup) AS pw, sum(r * sup) AS rw, sum(f * sup) AS fw FROM pc3)
, mic AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pmi,
                    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rmi FROM agg)
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'testprecision_micro' AS metric, pmi AS value FROM mic
  UNION ALL SELECT 'testrecall_micro', rmi FROM mic
  UNION ALL SELECT 'testf1_micro', CASE WHEN pmi + rmi > 0 THEN 2 * pmi * rmi / (pmi + rmi) ELSE 0.0 END FROM mic
  UNION ALL SELECT 'testprecision_macro', pm FROM mic
  UNION ALL SELECT 'testrecall_macro', rm FROM mic
  UNION ALL SELECT 'testf1_macro', fm FROM mic
  UNION ALL SELECT 'testprecision_weighted', CASE WHEN sup > 0 THEN pw / sup ELSE 0.0 END FROM mic
  UNION ALL SELECT 'testrecall_weighted', CASE WHEN sup > 0 THEN rw / sup ELSE 0.0 END FROM mic
  UNION ALL SELECT 'testf1_weighted', CASE WHEN sup > 0 THEN fw / sup ELSE 0.0 END FROM mic)"""
    q["eval_report"] = EVAL_CTES + """
SELECT CAST(cls AS VARCHAR) AS row, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
       sup::BIGINT AS support FROM pc3
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(sup), 6), sum(sup)::BIGINT FROM pc3
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(sup)::BIGINT FROM pc3
UNION ALL SELECT 'weighted avg', round(sum(p * sup) / sum(sup), 6), round(sum(r * sup) / sum(sup), 6),
                 round(sum(f * sup) / sum(sup), 6), sum(sup)::BIGINT FROM pc3"""
    return q



# --- write-back -------------------------------------------------------------------------

def _sem2tag_map() -> str:
    from contentmark.functions.tags import SEMANTIC_NAME_TAG_MAP
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SEMANTIC_NAME_TAG_MAP.items()) + "}"


def _tagof(x: str) -> str:
    return f"coalesce(map_extract_value({_sem2tag_map()}, {x}), {x})"


def _unq(x: str) -> str:
    return f"regexp_replace({x}, '^\"|\"$', '', 'g')"


WB_CTES = f"""
, wb AS (SELECT page_id, part, pos, label AS lab,
    {_tagof('tl[-1]')} AS t_tag,
    CASE WHEN len(tl) >= 2 THEN {_tagof('tl[-2]')} END AS t_parent,
    list_transform(tl, lambda x: {_tagof('x')}) AS chain,
    {_unq('ts[-1]')} AS needle,
    regexp_replace({_unq("array_to_string(ts, ', ')")}, '{WS}', '', 'g') AS all_key
  FROM blocks)
, anc AS (SELECT n.page_id, n.pre, list(a.tag ORDER BY a.pre) AS anc_tags
  FROM (SELECT page_id, pre, unnest(path) AS ap FROM nodes) n
  JOIN nodes a ON a.page_id = n.page_id AND a.pre = n.ap WHERE n.ap <> n.pre GROUP BY n.page_id, n.pre)
, nsub AS (SELECT n.page_id, n.pre, n.tag, p.tag AS parent_tag, coalesce(an.anc_tags, []) AS anc_tags,
    coalesce(string_agg(t.text, '' ORDER BY t.i), '') AS sub,
    coalesce(string_agg(t.text, '' ORDER BY t.i) FILTER (WHERE t.tag NOT IN ('script', 'style')), '') AS plain
  FROM nodes n LEFT JOIN nodes p ON p.page_id = n.page_id AND p.pre = n.parent
  LEFT JOIN anc an ON an.page_id = n.page_id AND an.pre = n.pre
  LEFT JOIN tpath t ON t.page_id = n.page_id AND list_contains(t.path, n.pre)
  GROUP BY n.page_id, n.pre, n.tag, p.tag, an.anc_tags)
, nk AS MATERIALIZED (SELECT *, {_unq(f"regexp_replace(plain, '{WS}', '', 'g')")} AS k5,
    '|' || array_to_string(anc_tags, '|') || '|' AS anc_str FROM nsub)
, whits AS MATERIALIZED (
  SELECT DISTINCT b.page_id, b.part, b.pos, 1 AS tier, t.node AS pre FROM wb b
    JOIN tpath t ON t.page_id = b.page_id AND t.tag = b.t_tag AND contains(t.text, b.needle)
  UNION ALL SELECT b.page_id, b.part, b.pos, 2, n.pre FROM wb b
    JOIN nk n ON n.page_id = b.page_id AND n.tag = b.t_parent AND contains(n.sub, b.needle)
  UNION ALL SELECT b.page_id, b.part, b.pos, 3, n.pre FROM wb b
    JOIN nk n ON n.page_id = b.page_id AND n.tag = b.t_tag AND n.parent_tag = b.t_parent
     AND contains(n.sub, b.needle)
  UNION ALL SELECT b.page_id, b.part, b.pos, 4, n.pre FROM wb b
    JOIN nk n ON n.page_id = b.page_id AND n.tag = b.t_tag AND contains(n.sub, b.needle)
     AND (len(b.chain) = 1 OR regexp_matches(n.anc_str, '\\|' || array_to_string(
          list_transform(b.chain[1:len(b.chain) - 1], lambda x: regexp_escape(x)), '\\|(.*\\|)?') || '\\|'))
  UNION ALL SELECT b.page_id, b.part, b.pos, 5, n.pre FROM wb b
    JOIN nk n ON n.page_id = b.page_id AND n.tag = b.t_tag AND n.k5 = b.all_key
  UNION ALL SELECT b.page_id, b.part, b.pos, 6, n.pre FROM wb b
    JOIN nk n ON n.page_id = b.page_id AND n.tag = b.t_parent AND n.k5 = b.all_key)
, cnt AS (SELECT b.page_id, b.part, b.pos,
    count(h.pre) FILTER (WHERE h.tier = 1) AS n1, count(h.pre) FILTER (WHERE h.tier = 2) AS n2,
    count(h.pre) FILTER (WHERE h.tier = 3) AS n3, count(h.pre) FILTER (WHERE h.tier = 4) AS n4,
    count(h.pre) FILTER (WHERE h.tier = 5) AS n5, count(h.pre) FILTER (WHERE h.tier = 6) AS n6
  FROM wb b LEFT JOIN whits h ON h.page_id = b.page_id AND h.part = b.part AND h.pos = b.pos
  GROUP BY b.page_id, b.part, b.pos)
, dec AS MATERIALIZED (SELECT page_id, part, pos, CASE WHEN n1 = 1 THEN 1 WHEN n1 = 0 AND n2 = 1 THEN 2
    WHEN n3 = 1 THEN 3 WHEN n4 = 1 THEN 4 WHEN n5 = 1 THEN 5 ELSE 6 END AS tier FROM cnt)
, res AS (SELECT h.* FROM whits h JOIN dec d USING (page_id, part, pos, tier))
, ann AS (SELECT r.page_id, r.pre, arg_max(b.lab, b.part * 1000000 + b.pos) AS label
  FROM res r JOIN wb b USING (page_id, part, pos) GROUP BY r.page_id, r.pre)
"""


def writeback_oracles() -> dict[str, str]:
    base = NODE_CTES + GOLD_CTES + BLOCK_CTES
    wb = base + WB_CTES
    q: dict[str, str] = {}
    q["tag_map"] = base + f"""
SELECT page_id, part, pos, array_to_string(list_transform(tl, lambda x: {_tagof('x')}), ' ') AS tags
FROM blocks"""
    q["clean_text"] = base + f"""
SELECT page_id, part, pos, {_unq('ts[-1]')} AS text FROM blocks"""
    q["match_tiers"] = wb + """
SELECT page_id, part, pos, n1::BIGINT AS n1, n2::BIGINT AS n2, n3::BIGINT AS n3,
       n4::BIGINT AS n4, n5::BIGINT AS n5, n6::BIGINT AS n6 FROM cnt"""
    q["match_resolve"] = wb + """
SELECT page_id, part, pos, tier, pre::BIGINT AS pre FROM res"""
    q["annotate"] = wb + """
SELECT page_id, pre::BIGINT AS pre, label FROM ann"""
    q["highlight"] = wb + SINGLE_STRING + """
, marks AS (SELECT DISTINCT s.page_id, s.i FROM sstr s JOIN ann a ON a.page_id = s.page_id AND a.pre = s.pre
            WHERE a.label = 1)
, st AS (SELECT w.page_id, w.i, a.label FROM walk w JOIN ann a ON a.page_id = w.page_id AND a.pre = w.pre)
SELECT o.page_id, string_agg(CASE
         WHEN st.i IS NOT NULL THEN regexp_replace(o.tok, '(/?>)$', ' predicted_label="' || st.label || '"\\1')
         WHEN mk.i IS NOT NULL THEN '<mark>' || o.tok || '</mark>'
         ELSE o.tok END, '' ORDER BY o.i) AS html
FROM o LEFT JOIN st ON st.page_id = o.page_id AND st.i = o.i
LEFT JOIN marks mk ON mk.page_id = o.page_id AND mk.i = o.i GROUP BY o.page_id"""
    q["label_pages"] = wb + """
, st AS (SELECT w.page_id, w.i, a.label FROM walk w JOIN ann a ON a.page_id = w.page_id AND a.pre = w.pre)
SELECT o.page_id, string_agg(CASE WHEN st.i IS NOT NULL
         THEN regexp_replace(o.tok, '(/?>)$', ' predicted_label="' || st.label || '"\\1') ELSE o.tok END,
         '' ORDER BY o.i) AS html
FROM o LEFT JOIN st ON st.page_id = o.page_id AND st.i = o.i GROUP BY o.page_id"""
    return q


def oracles() -> dict[str, str]:
    """Query name -> DuckDB SQL (every registered query but the rows-only ones)."""
    q = node_oracles()
    q.update(block_oracles())
    q.update(model_oracles())
    q.update(writeback_oracles())
    q["model_reload"] = q["decode"]
    q["eval_pairs"] = q["decode"].replace(
        "SELECT page_id, part, (generate_subscripts(path, 1) - 1)::INTEGER AS pos, unnest(path) AS prediction FROM fin",
        """, dp AS (SELECT page_id, part, (generate_subscripts(path, 1) - 1)::INTEGER AS pos,
                   unnest(path) AS prediction FROM fin)
SELECT s.label, dp.prediction, count(*)::BIGINT AS n FROM split s
JOIN dp ON dp.page_id = s.page_id AND dp.part = s.part AND dp.pos = s.pos
GROUP BY s.label, dp.prediction""")
    q["attach_predictions"] = q["decode"].replace(
        "SELECT page_id, part, (generate_subscripts(path, 1) - 1)::INTEGER AS pos, unnest(path) AS prediction FROM fin",
        """, dp AS (SELECT page_id, part, (generate_subscripts(path, 1) - 1)::INTEGER AS pos,
                   unnest(path) AS prediction FROM fin)
SELECT s.page_id, s.part, s.pos, s.label, dp.prediction FROM split s
LEFT JOIN dp ON dp.page_id = s.page_id AND dp.part = s.part AND dp.pos = s.pos""")
    return q
