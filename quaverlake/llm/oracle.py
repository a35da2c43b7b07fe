"""DuckDB SQL for the operators whose whole result SQL can give on the driver's comparison size."""

#: Components as the least id in the transitive closure of the links.
CLOSURE = "r AS (SELECT a AS id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id), m AS (SELECT id, min(c) AS c FROM r GROUP BY 1)"

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
{CLOSURE} SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.doc_id"""

NEAR_DUP = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{CLOSURE}, k AS (SELECT a AS id, count(*) AS k FROM l GROUP BY 1)
SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN m ON m.id = vec_id LEFT JOIN k ON k.id = vec_id"""

SQL = {"op3_jaccard": JACCARD, "op9_near_dup": NEAR_DUP}


#: The table of the cyclic redundancy check of 32 bits, by its rule, and the checksum of a list of bytes.
CRC_TABLE = "tb AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc_table)"


def crc_sql(byte_list: str) -> str:
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte_list}), lambda a, b: xor(a >> 8, crc_table[1 + xor(a, b) % 256])), 4294967295)"


def secrets_sql() -> str:
    """Every rule's matches with the code points before them; lookarounds and possessive marks are left out where whole runs are taken anyway."""
    run, close = "[A-Za-z0-9_-]+", '[^\\s/:@"\'\'<>]+'
    assign = '(?i:password|passwd|secret|token|api_?key)["\'\']?\\x20*[:=]\\x20*["\'\']?([A-Za-z0-9+/_.=-]+)'
    mixed = "length(x) >= 32 AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') AND len(regexp_extract_all(x, '[0-9]')) >= 3 AND len(list_distinct(string_split(x, ''))) >= 16"
    rules = [
        ("assign", assign, f"length(regexp_extract(x, '{assign}', 1)) >= 8"),
        ("access", "AKIA[A-Z0-9]+", "length(x) >= 16"),
        ("hex", "[0-9a-f]+", "length(x) >= 32"),
        ("github", "gh[oprsu]_[A-Za-z0-9]+", "length(x) >= 40"),
        ("slack", "xox[abprs]-[A-Za-z0-9-]+", "length(x) >= 20"),
        ("google", f"AIza{run}", "length(x) >= 39"),
        ("jwt", rf"eyJ{run}\.{run}\.{run}", "length(x) >= 40"),
        ("pem", r"-----BEGIN [A-Z0-9 ]*-----[A-Za-z0-9+/=\s:,-]*?-----END [A-Z0-9 ]*-----", "regexp_matches(x, '^-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----')"),
        ("url", f"://{close}:{close}@", "length(x) >= 8"),
        ("mixed", run, mixed),
    ]
    each = " UNION ALL ".join(
        f"SELECT rid, {k} AS k, '{kind}' AS kind, s, s + length(x) AS e FROM (SELECT rid, m[i] AS x, list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS s FROM (SELECT rid, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d))) WHERE {valid}"
        for k, (kind, pattern, valid) in enumerate(rules)
    )
    text = lambda where: f"coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) FILTER ({where}), '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), f AS ({each})
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, sha256({text('k < 3')}) AS base_sha256, {text('k IS NOT NULL')} AS spans, sha256(any_value(t)) AS blob FROM d LEFT JOIN f USING (rid) GROUP BY d.rid"""


SPELLING = f"""WITH RECURSIVE {CRC_TABLE}, r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS c FROM r WHERE length(run) >= 6 GROUP BY 1, 2),
h AS (SELECT run, c, {crc_sql("flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(x) - 64 AS BIGINT)] END))")} AS h FROM g, tb),
w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
e AS (SELECT word, left(word, i) || '*' || substr(word, i + 2) AS k, left(word, i) || substr(word, i + 2) AS gone FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
x AS (SELECT DISTINCT a.word AS a, b.word AS b FROM e a JOIN e b ON a.k = b.k AND a.word <> b.word UNION SELECT e.word, v.word FROM e JOIN v ON v.word = gone UNION SELECT v.word, e.word FROM e JOIN v ON v.word = gone),
b AS (SELECT a AS word, count(*) AS n_near, max(n) AS most FROM x JOIN v ON v.word = x.b GROUP BY 1), o AS (SELECT x.a AS word, min(v.word) AS form FROM x JOIN v ON v.word = x.b JOIN b ON b.word = x.a AND v.n = b.most GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * v.n THEN form END AS form, CASE WHEN most >= 5 * v.n THEN most END AS form_n FROM v LEFT JOIN b ON b.word = v.word LEFT JOIN o ON o.word = v.word),
c AS (SELECT word, word AS last, 0 AS d FROM f UNION ALL SELECT c.word, f.form, d + 1 FROM c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL), z AS (SELECT word, arg_max(last, d) AS root FROM c GROUP BY 1)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON z.word = f.word"""

TRIE = f"""WITH {CRC_TABLE}, o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS t, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, {crc_sql("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o), tb),
r AS (SELECT h.conv_id, i AS k, t, chars FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100 AND i <= h UNION ALL SELECT o.conv_id, 10 + i, t, chars FROM o JOIN h ON h.conv_id = o.conv_id WHERE i > h),
p AS (SELECT conv_id, chars, row_number() OVER w AS d, md5(string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS node FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
m AS (SELECT conv_id, d, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY d), '') AS above, chars FROM p UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM h),
l AS (SELECT conv_id, max(d) AS d FROM m GROUP BY 1), n AS (SELECT node, d, min(m.conv_id) AS rep, any_value(above) AS above, count(*) AS k, any_value(chars) AS chars FROM m GROUP BY 1, 2),
e AS (SELECT node, m.d, string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) AS ids FROM m JOIN l ON l.conv_id = m.conv_id AND l.d = m.d GROUP BY 1, 2), c AS (SELECT above AS node, d - 1 AS d, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1, 2),
u AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN c ON c.node = n.node AND c.d = n.d), s AS (SELECT m.node, m.d, count(*) FILTER (kids = 0) AS leaves, CAST(sum((k - 1) * u.chars) AS BIGINT) AS saved FROM u JOIN m ON m.conv_id = u.rep AND m.d <= u.d GROUP BY 1, 2)
SELECT u.rep AS conv_id, CAST(u.d AS BIGINT) AS depth, a.rep AS parent_conv_id, u.k AS n_convs, u.kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM u JOIN s ON s.node = u.node AND s.d = u.d LEFT JOIN e ON e.node = u.node AND e.d = u.d LEFT JOIN n a ON a.node = u.above AND a.d = u.d - 1"""

SQL |= {"op11_secrets": secrets_sql(), "op12_spelling": SPELLING, "op13_prefix_trie": TRIE}
