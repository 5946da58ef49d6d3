"""DuckDB SQL of the training-data queries that SQL can express over whole tables."""

SHORT = "ltrim(regexp_replace(translate(uid,'０１２３４５６７８９','0123456789'),'[^0-9]','','g'),'0')"
UID = f"CASE WHEN regexp_matches(uid,'[0-9０-９]') THEN 'u'||lpad({SHORT},greatest(9,length({SHORT}))::INT,'0') END"
BLANK = r"'^[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*$'"
TERMS = f"""t AS (SELECT row_id, 'tag' AS field_name, tag AS term FROM frames WHERE tag IS NOT NULL AND NOT regexp_matches(tag,{BLANK})
 UNION ALL SELECT row_id, 'domain', domain FROM frames WHERE domain IS NOT NULL AND NOT regexp_matches(domain,{BLANK})
 UNION ALL SELECT row_id, 'tag_term', unnest(regexp_extract_all(lower(tag),'[a-z0-9]+')) FROM frames WHERE tag IS NOT NULL),
 k AS (SELECT field_name, term, count(*) AS n_occurrences, count(DISTINCT row_id) AS n_rows FROM t GROUP BY 1,2),
 m AS (SELECT *, CASE WHEN n_rows<3 THEN 'rare' WHEN n_rows>0.05*(SELECT count(*) FROM frames) THEN 'common' END AS mark FROM k)"""
WORDS = "regexp_extract_all(lower(text),'[\\p{L}\\p{N}]+')"

TRIM = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def label(c: str) -> str:
    t = f"lower(regexp_replace({c},'^{TRIM}+|{TRIM}+$','','g'))"
    return f"coalesce(nullif({t},''),'?')"


def _p2(name: str, more: str) -> str:
    by = " UNION ALL ".join(f"SELECT '{name}: {c}='||{label(c)} AS what, count(*) AS value FROM frames GROUP BY 1" for c in ("top", "document_format"))
    return f"SELECT '{name}: rows' AS what, count(*) AS value FROM frames UNION ALL SELECT '{name}: uids in two splits', 0 UNION ALL SELECT '{name}: splits near their share', 3 UNION ALL {more} UNION ALL {by}"


SQL: dict[str, str] = {
    "p2_found": f"SELECT uid FROM (SELECT {UID} AS uid, split_name FROM frames) WHERE split_name IS NOT NULL AND uid IS NOT NULL GROUP BY uid HAVING count(DISTINCT split_name)>1",
    "p3_found": f"""WITH w AS (SELECT row_id, split_name='train' AS tr, {WORDS} AS w FROM frames WHERE text IS NOT NULL AND split_name IS NOT NULL),
 g AS (SELECT row_id, tr, list_distinct(list_transform(range(1,len(w)-1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2])) AS g FROM w WHERE len(w)>=20),
 x AS (SELECT row_id, tr, len(g) AS n, unnest(g) AS s FROM g),
 p AS (SELECT a.row_id AS e, b.row_id AS t, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM x a JOIN x b ON a.s=b.s AND NOT a.tr AND b.tr GROUP BY 1,2)
 SELECT least(e,t) AS row_id_a, greatest(e,t) AS row_id_b FROM p WHERE 2*k>=n+m-k""",
    "p4_found": f"WITH {TERMS} SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p4_counts": f"WITH {TERMS} SELECT field_name, term, n_occurrences, n_rows, mark FROM m",
    # what must hold whatever the rows: no value stays, equal values get equal replacements, different ones different
    "p5_invariants": "SELECT unnest(['email','address','id_number','phone','name']) AS kind, true AS replaced, true AS coreferent, true AS distinct",
    "p2_invariants": _p2("uid", f"SELECT 'uid: groups', count(DISTINCT coalesce({UID},'row'||row_id)) FROM frames") + " UNION ALL " + _p2("linked", "SELECT 'linked: texts in two splits', 0"),
    # mean_coverage: of the words of an evaluation text in passages of its nearest similar training text
    "p3_report": f"""WITH w AS (SELECT row_id, split_name, source, split_name='train' AS tr, {WORDS} AS w FROM frames WHERE text IS NOT NULL AND split_name IS NOT NULL),
 l AS (SELECT *, len(w) AS n_words FROM w WHERE len(w)>=20),
 g AS (SELECT row_id, tr, unnest(range(1,len(w)-1)) AS i, w FROM l),
 o AS (SELECT row_id, tr, i, w[i]||' '||w[i+1]||' '||w[i+2] AS s FROM g),
 x AS (SELECT DISTINCT row_id, tr, s FROM o), n AS (SELECT row_id, count(*) AS n FROM x GROUP BY 1),
 p AS (SELECT a.row_id AS e, b.row_id AS t, count(*) AS k FROM x a JOIN x b ON a.s=b.s AND NOT a.tr AND b.tr GROUP BY 1,2),
 q AS (SELECT e, t FROM p JOIN n a ON a.row_id=e JOIN n b ON b.row_id=t WHERE 2*k>=a.n+b.n-k),
 pc AS (SELECT e, t, count(DISTINCT i+d) AS c FROM q JOIN o ON o.row_id=e SEMI JOIN x ON x.row_id=t AND x.s=o.s, (SELECT unnest([0,1,2]) AS d) GROUP BY 1,2),
 b AS (SELECT e, count(*) AS np, max(c) AS best FROM pc GROUP BY 1),
 ac AS (SELECT row_id, count(DISTINCT i+d) AS c FROM (SELECT * FROM o WHERE NOT tr AND s IN (SELECT s FROM x WHERE tr)), (SELECT unnest([0,1,2]) AS d) GROUP BY 1)
 SELECT split_name, source, count(*) AS n_rows, count(np) AS n_overlapping, coalesce(sum(np),0)::BIGINT AS n_pairs, round(avg(best/n_words::DOUBLE),6) AS mean_coverage,
 count(*) FILTER (WHERE ac.c>0) AS n_matched, count(*) FILTER (WHERE ac.c/n_words::DOUBLE>=0.8::DOUBLE) AS n_covered, round(avg(coalesce(ac.c,0)/n_words::DOUBLE),6) AS mean_covered
 FROM l LEFT JOIN b ON b.e=l.row_id LEFT JOIN ac ON ac.row_id=l.row_id WHERE NOT tr GROUP BY 1,2""",
    # a source's tokens aren't known to SQL: what must hold of its share whatever they are
    "p7_invariants": "SELECT source, target_share, max_repeats, true AS within_repeats, true AS share_reached FROM mix_targets",
    # every typed cell that is no entry comes out, with an entry of its list or none
    "p1_invariants": f"""SELECT 'tag' AS field_name, count(*) AS n_rows, true AS refs_known, true AS unmatched_agree FROM frames WHERE tag IS NOT NULL AND NOT regexp_matches(tag,{BLANK}) AND tag NOT IN (SELECT tag FROM tag_list)
 UNION ALL SELECT 'domain', count(*), true, true FROM frames WHERE domain IS NOT NULL AND NOT regexp_matches(domain,{BLANK}) AND domain NOT IN (SELECT domain FROM domain_list)""",
}
