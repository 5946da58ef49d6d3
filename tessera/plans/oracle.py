"""DuckDB SQL with the same results as the queries, written independently of the operators."""

from __future__ import annotations

WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sing(t: str) -> str:
    return f"CASE WHEN length({t})<=3 OR NOT ends_with({t},'s') OR regexp_matches({t},'(ss|is|us|as|ys)$') THEN {t} WHEN length({t})>4 AND ends_with({t},'ies') THEN left({t},length({t})-3)||'y' ELSE left({t},length({t})-1) END"


def norm(x: str) -> str:
    return f"coalesce(array_to_string(list_transform(regexp_extract_all(lower(coalesce({x},'')),'[a-z0-9]+'), lambda w: {sing('w')}),' '),'')"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x},'')),'[a-z][a-z0-9]+')"


def tagtoks(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x},' '), lambda w: w<>'' AND w NOT IN ('a','an','the','of','for','and','to','in','on')))"


DIGITS = "regexp_replace(translate(uid,'０１２３４５６７８９','0123456789'),'[^0-9]','','g')"
SHORT = f"ltrim({DIGITS},'0')"
C = f"""c AS (SELECT row_id, CASE WHEN {DIGITS}<>'' THEN 'u'||lpad({SHORT},greatest(9,length({SHORT}))::INT,'0') END AS uid, domain, lower(trim(top)) AS top, {norm('tag')} AS tag,
 description, lower(trim(document_format)) AS document_format, lower(trim(locale)) AS locale, text, source, split_name AS split FROM frames)"""
V = "v AS (SELECT top, tag_idx, " + norm("tag") + " AS tag FROM tag_list WHERE top<>'other')"
IND = "('healthcare','finance','government')"
TOPIDX = "CASE top WHEN 'healthcare' THEN 0 WHEN 'finance' THEN 1 WHEN 'government' THEN 2 WHEN 'other' THEN 3 ELSE -1 END"
P = "p AS (SELECT row_id, lower(trim(top)) AS top, " + norm("tag") + " AS tag, score, top_confidence, tag_confidence FROM (SELECT DISTINCT * FROM predictions))"
CMP = f"""{C}, {P}, m AS (SELECT c.row_id, c.top AS gold_top, CASE WHEN c.top<>'other' THEN c.tag END AS gold_tag, c.domain, c.locale, c.document_format, c.text,
 p.top, CASE WHEN p.top<>'other' THEN p.tag END AS tag, p.top_confidence, p.top IS NOT DISTINCT FROM c.top AS ok FROM c JOIN p USING (row_id)),
 e AS (SELECT *, ok AND (coalesce(gold_top='other',false) OR tag IS NOT DISTINCT FROM gold_tag) AS ex FROM m)"""
TRAINV = f"tv AS (SELECT top, CAST(row_number() OVER (PARTITION BY top ORDER BY tag)-1 AS INT) AS tag_idx, tag FROM (SELECT DISTINCT top, tag FROM c WHERE split='train' AND top IN {IND} AND tag<>''))"
ONE = "one AS (SELECT uid, arg_min(top,row_id) AS top0, arg_min(row_id,row_id) AS row_id FROM c WHERE uid IS NOT NULL GROUP BY uid), o AS (SELECT c.uid, c.row_id, c.top, c.document_format FROM c JOIN one USING (row_id))"
SPLIT = f"""{ONE}, k AS (SELECT uid, concat_ws('|',top,document_format) AS stratum, md5('20240917|'||uid) AS h FROM o),
 r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, uid) AS i, count(*) OVER (PARTITION BY stratum) AS n FROM k),
 q AS (SELECT *, round_even(n*0.7::DOUBLE,0) AS t0, round_even(n*0.15::DOUBLE,0) AS d0 FROM r),
 q1 AS (SELECT *, CASE WHEN n>=3 THEN greatest(1,least(t0,n-2)) ELSE t0 END AS t FROM q),
 q2 AS (SELECT *, CASE WHEN n>=3 THEN greatest(1,least(d0,n-t-1)) ELSE d0 END AS dv FROM q1),
 s AS (SELECT uid, stratum, CASE WHEN i<=t THEN 'train' WHEN i<=t+dv THEN 'dev' ELSE 'test' END AS split FROM q2)"""
HEAD = f"""h0 AS (SELECT *, left(coalesce(text,''),400) AS head FROM c),
 h1 AS (SELECT *, list_filter(list_transform(list_concat(regexp_extract_all(head,'(?m)^{WS}*#{{1,6}}{WS}*([^\\n#]{{3,120}})',1), list_concat(regexp_extract_all(head,'(?m)^{WS}*\\*\\*([^*\\n]{{3,120}})\\*\\*{WS}*:?{WS}*$',1),
   regexp_extract_all(head,'(?m)^{WS}*__([^_\\n]{{3,120}})__{WS}*:?{WS}*$',1))), lambda x: trim(x,' :*_#-')), lambda x: x<>'' AND NOT regexp_matches(x,'^(```|~~~|\\||[-=_*\\s]+$)')) AS expl,
   list_transform(regexp_split_to_array(head,'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x,'^{WS}+|{WS}+$','','g')) AS raws FROM h0),
 h2 AS (SELECT *, list_filter(list_transform(raws, lambda x: CASE WHEN NOT regexp_matches(x,'^(```|~~~|\\||[-=_*\\s]+$)') AND length(trim(x,' :*_#-\t'))>=3
   AND NOT regexp_matches(trim(x,' :*_#-\t'),'(?i)^\\s*(dear\\b|to whom it may concern|hello\\b|hi\\b|greetings\\b|subject\\s*:|re\\s*:)')
   THEN CASE WHEN length(regexp_replace(regexp_split_to_array(trim(x,' :*_#-\t'),'[.!?]{WS}')[1],'^{WS}+|{WS}+$','','g')) BETWEEN 3 AND 120 THEN regexp_replace(regexp_split_to_array(trim(x,' :*_#-\t'),'[.!?]{WS}')[1],'^{WS}+|{WS}+$','','g') ELSE '' END END), lambda x: x IS NOT NULL) AS ls FROM h1),
 h3 AS (SELECT *, list_concat(expl, list_filter(ls, lambda x, i: x<>'' AND (i=1 OR len(expl)+len(list_filter(ls[1:i-1], lambda y: y<>''))<14))) AS cand FROM h2),
 h4 AS (SELECT *, list_filter(cand, lambda x, i: list_position(list_transform(cand, lambda y: lower(y)), lower(x))=i) AS hs FROM h3)"""
LEX = f"""{C}, {V}, {HEAD}, tr AS (SELECT * FROM c WHERE split='train'), nn AS (SELECT ln(count(*)::DOUBLE) AS ln_n FROM tr),
 df AS (SELECT t AS token, count(*) AS df FROM (SELECT unnest(list_distinct({toks("left(coalesce(text,''),2000)")})) AS t FROM tr) GROUP BY 1),
 tw0 AS (SELECT top, tag_idx, tag, unnest({tagtoks('tag')}) AS token FROM v),
 tw AS (SELECT tw0.*, greatest(coalesce(ln_n-ln(1.0::DOUBLE+df),ln_n),0.01::DOUBLE) AS w FROM tw0 LEFT JOIN df USING (token), nn),
 tt AS (SELECT *, sum(w) OVER (PARTITION BY top,tag_idx) AS total, count(*) OVER (PARTITION BY top,tag_idx) AS n_tokens FROM tw),
 b AS (SELECT row_id, list_transform(hs[1:5], lambda x: list_distinct({toks('x')})) AS heads, list_transform(hs[1:6], lambda x: {norm('x')}) AS norms, {norm("left(coalesce(text,''),2500)")} AS body FROM h4),
 b2 AS (SELECT *, flatten(heads) AS ht, string_split(body,' ') AS bt FROM b),
 sn AS (SELECT row_id, token, list_contains(ht,token) AS ih, list_contains(bt,token) AS ib FROM (SELECT row_id, ht, bt, unnest(list_distinct(list_concat(ht,bt))) AS token FROM b2)),
 hit AS (SELECT row_id, top, tag_idx, tag, n_tokens, total, sum(CASE WHEN ih THEN 2*w ELSE w END) AS got, count(*) FILTER (WHERE ib) AS nb FROM sn JOIN tt USING (token) GROUP BY ALL),
 lx AS (SELECT hit.row_id, top, tag_idx, tag, got/(2.0::DOUBLE*total) + CASE WHEN list_contains(norms,tag) THEN 1.0::DOUBLE WHEN len(list_filter(heads, lambda s: len(s)>0 AND list_has_all(s,{tagtoks('tag')})))>0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS heading,
   CASE WHEN nb=n_tokens AND instr(body,tag)>0 THEN 1.0::DOUBLE-0.5::DOUBLE*(instr(body,tag)-1)/greatest(length(body),1) ELSE 0.0::DOUBLE END AS verbatim FROM hit JOIN b USING (row_id))"""
# every document against every tag, 0 without evidence
DENSE = f"""{LEX}, dx AS (SELECT c.row_id, v.top, v.tag_idx, v.tag, coalesce(lx.heading,0.0::DOUBLE) AS heading, coalesce(lx.verbatim,0.0::DOUBLE) AS verbatim
 FROM c CROSS JOIN v LEFT JOIN lx ON lx.row_id=c.row_id AND lx.top=v.top AND lx.tag_idx=v.tag_idx)"""
TIER = f"""{DENSE}, sc AS (SELECT *, heading+0.5::DOUBLE*verbatim AS score FROM dx),
 t2 AS (SELECT row_id, top, tag_idx, tag, score-mx-ln(sum(exp(score-mx)) OVER (PARTITION BY row_id,top)) AS lp FROM (SELECT *, max(score) OVER (PARTITION BY row_id,top) AS mx FROM sc)),
 b1 AS (SELECT row_id, top, max(score) AS score FROM sc GROUP BY 1,2 UNION ALL SELECT row_id, 'other', 0.75::DOUBLE FROM c),
 t1 AS (SELECT row_id, top, score-mx-ln(sum(exp(score-mx)) OVER (PARTITION BY row_id)) AS lp FROM (SELECT *, max(score) OVER (PARTITION BY row_id) AS mx FROM b1))"""
JOINT = f""", bt2 AS (SELECT row_id, top, arg_max(tag,(lp,-tag_idx)) AS tag, max(lp) AS tlp FROM t2 GROUP BY 1,2),
 al AS (SELECT t1.row_id, t1.top, bt2.tag, t1.lp, bt2.tlp FROM t1 LEFT JOIN bt2 USING (row_id,top) WHERE t1.top='other' OR tlp IS NOT NULL)"""


def joint(lam: str) -> str:
    return f"CASE WHEN top='other' THEN lp ELSE lp+{lam}*tlp END"


WORDS = "regexp_extract_all(strip_accents(lower(left(coalesce(text,''),2500))),'[\\p{L}\\p{M}\\p{N}_]{2,}')"
PAIRED = f"SELECT row_id, unnest(list_concat(t, list_transform(range(1,len(t)), lambda i: t[i]||' '||t[i+1]))) AS term FROM (SELECT row_id, {WORDS} AS t FROM c)"
TFIDF = f"""{C}, {V}, tf AS (SELECT row_id, term, count(*) AS tf FROM ({PAIRED}) GROUP BY 1,2), n AS (SELECT count(*) AS n FROM c),
 tm AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1 HAVING count(*)>=3),
 ti AS (SELECT term, df, cf, ln(1.0::DOUBLE+n)-ln(1.0::DOUBLE+df)+1.0::DOUBLE AS idf FROM tm, n),
 x AS (SELECT row_id, term, (1.0::DOUBLE+ln(tf))*idf AS x FROM tf JOIN ti USING (term)),
 w AS (SELECT row_id, term, x/sqrt(sum(x*x) OVER (PARTITION BY row_id)) AS w FROM x)"""
ROC = f"""{TFIDF}, lab AS (SELECT row_id, c.top||chr(9)||c.tag AS label FROM c JOIN v ON v.top=c.top AND v.tag=c.tag WHERE split='train'), ln_ AS (SELECT label, count(*) AS k FROM lab GROUP BY 1),
 cm AS (SELECT label, term, sum(w)/any_value(k) AS m FROM w JOIN lab USING (row_id) JOIN ln_ USING (label) GROUP BY 1,2),
 ce AS (SELECT label, term, m/sqrt(sum(m*m) OVER (PARTITION BY label)) AS c FROM cm)"""
SPLIT_LABEL = "split_part(label,chr(9),1) AS top, split_part(label,chr(9),2) AS tag"
# character n-grams of 3 to 5 inside padded words of the first 1,200 characters
GRAMS = f"""{C}, pw AS (SELECT row_id, unnest(list_transform(list_filter(regexp_split_to_array(lower(left(coalesce(text,''),1200)),'{WS}+'), lambda w: w<>''), lambda w: ' '||w||' ')) AS w FROM c),
 gr AS (SELECT row_id, unnest(flatten(list_transform(range(3,least(5,length(w))+1), lambda n: list_transform(range(1,length(w)-n+2), lambda i: substring(w,i,n))))) AS term FROM pw),
 tf AS (SELECT row_id, term, count(*) AS tf FROM gr GROUP BY 1,2)"""
TEMPERATURES = ",".join(f"'{0.05 * 400 ** (i / 59)!r}'::DOUBLE" for i in range(60))
GPONLY = f"""gp AS (SELECT c.top, c.tag AS gold, p.tag AS pred FROM c JOIN p ON c.row_id=p.row_id AND c.top=p.top WHERE c.top IN {IND} AND p.tag<>''
 AND EXISTS (SELECT 1 FROM v WHERE v.top=c.top AND v.tag=c.tag) AND EXISTS (SELECT 1 FROM v WHERE v.top=c.top AND v.tag=p.tag))"""
GP = f"{C}, {P}, {V}, {GPONLY}"
ALIAS = "al AS (SELECT top, tag_a AS tag, max(tag_b) AS canonical FROM tag_pairs WHERE n_confused>=10 GROUP BY 1,2)"


def avg6(cond: str, where: str = "true") -> str:
    return f"round(coalesce(avg(({cond})::INT::DOUBLE) FILTER (WHERE {where}),0.0),6)"


SEVEN = "uid, domain, document_type, document_description, document_format, locale, text"
CONF = f"WITH {CMP}, l AS (SELECT unnest(['healthcare','finance','government','other']) AS x), g AS (SELECT a.x AS gold_top, b.x AS top FROM l a, l b), cf AS (SELECT gold_top, top, coalesce(k,0) AS n FROM g LEFT JOIN (SELECT gold_top, top, count(*) AS k FROM e GROUP BY 1,2) USING (gold_top,top))"
CLASSES = f"{CONF}, cl AS (SELECT l.x AS label, (SELECT sum(n) FROM cf WHERE gold_top=x) AS support, (SELECT sum(n) FROM cf WHERE top=x) AS col, (SELECT sum(n) FROM cf WHERE top=x AND gold_top=x) AS tp FROM l), pc AS (SELECT label, support::BIGINT AS support, round(tp/greatest(col,1),5) AS precision, round(tp/greatest(support,1),5) AS recall, round(2*tp/greatest(support+col,1),5) AS f1 FROM cl)"
CURVE = f"""WITH {CMP}, z AS (SELECT top_confidence AS c, row_id, ok::INT AS ok FROM e WHERE top_confidence IS NOT NULL),
 r AS (SELECT c, row_number() OVER w AS r, sum(ok) OVER w AS hits, count(*) OVER () AS n FROM z WINDOW w AS (ORDER BY c DESC, row_id)),
 t AS (SELECT CAST(i AS INT) AS point, greatest(1, CAST(round_even(i/19.0::DOUBLE*(SELECT count(*) FROM z),0) AS BIGINT)) AS take FROM range(1,20) g(i)),
 cv AS (SELECT point, round(take/n,4) AS coverage, round(hits/take,5) AS accuracy, round(c,6) AS threshold FROM r JOIN t ON r.r=t.take)"""
CNT = "cnt AS (SELECT top, tag_a AS gold, tag_b AS pred, n_confused AS n FROM tag_pairs UNION ALL SELECT c.top, c.tag, c.tag, count(*) FROM c JOIN tag_list t ON t.top=c.top AND t.tag=c.tag GROUP BY 1,2)"
# Label merging: edges in falling order of affinity, one step of the recursion each; the state is every tag's cluster.
MERGE = f"""WITH RECURSIVE {C}, {CNT}, s AS (SELECT top, gold AS tag, sum(n) AS s FROM cnt GROUP BY 1,2),
 nd AS (SELECT l.top, l.tag, row_number() OVER (PARTITION BY l.top ORDER BY tag_idx) AS i, coalesce(s.s,0)::BIGINT AS sup, count(*) OVER (PARTITION BY l.top) AS nn FROM tag_list l LEFT JOIN s USING (top,tag)),
 af AS (SELECT p.top, least(a.i,b.i) AS i, greatest(a.i,b.i) AS j, sum(p.n_confused)/greatest(any_value(a.sup)+any_value(b.sup),1) AS w FROM tag_pairs p JOIN nd a ON a.top=p.top AND a.tag=p.tag_a JOIN nd b ON b.top=p.top AND b.tag=p.tag_b GROUP BY 1,2,3),
 th AS (SELECT unnest([0.5,0.35,0.25,0.18,0.12,0.08]::DOUBLE[]) AS t),
 mx AS (SELECT a.top, a.nn, list(coalesce(af.w,0.0::DOUBLE) ORDER BY a.i, b.i) AS m FROM nd a JOIN nd b USING (top) LEFT JOIN af ON af.top=a.top AND af.i=least(a.i,b.i) AND af.j=greatest(a.i,b.i) GROUP BY 1,2),
 ed AS (SELECT t, top, i, j, row_number() OVER (PARTITION BY t,top ORDER BY w DESC, i DESC, j DESC) AS k FROM af, th WHERE w>=t),
 r AS (SELECT t, top, 0::BIGINT AS k, range(1,nn+1) AS st FROM th, mx
  UNION ALL SELECT t, top, k, CASE WHEN st[i]<>st[j] AND len(p)+len(q)<=8 AND list_min(flatten(list_transform(p, lambda a: list_transform(q, lambda b: m[(a-1)*nn+b]))))>=t*0.5::DOUBLE THEN list_transform(st, lambda x: CASE WHEN x=st[j] THEN st[i] ELSE x END) ELSE st END
  FROM (SELECT r.t, r.top, e.k, e.i, e.j, st, m, nn, list_filter(range(1,nn+1), lambda x: st[x]=st[e.i]) AS p, list_filter(range(1,nn+1), lambda x: st[x]=st[e.j]) AS q FROM r JOIN ed e ON e.t=r.t AND e.top=r.top AND e.k=r.k+1 JOIN mx ON mx.top=r.top)),
 fin AS (SELECT t, top, arg_max(st,k) AS st FROM r GROUP BY 1,2),
 cl AS (SELECT t, nd.top, nd.tag, nd.i, sup, st[nd.i] AS c FROM fin JOIN nd USING (top)),
 mg AS (SELECT t AS threshold, top, tag, first_value(tag) OVER (PARTITION BY t,top,c ORDER BY sup DESC, length(tag), i) AS canonical, count(*) OVER (PARTITION BY t,top,c) AS cluster_size FROM cl)"""

SQL: dict[str, str] = {
    "pool_scan": f"SELECT {SEVEN} FROM raw_records UNION ALL SELECT uid, domain, tag, description, document_format, locale, text FROM frames",
    "fetch_columns": f"SELECT {SEVEN} FROM raw_records",
    "split_cache": f"WITH {C} SELECT row_id, uid, top, split FROM c WHERE split IS NOT NULL",
    "embedding_cache_misses": f"WITH {C}, k AS (SELECT split, left(coalesce(text,''),2000) AS t FROM c) SELECT DISTINCT sha256(t) AS key, length(t) AS n_chars FROM k WHERE split IN ('dev','test') AND sha256(t) NOT IN (SELECT sha256(t) FROM k WHERE split='train')",
    "vocabulary_json": f"WITH {V} SELECT top, '['||string_agg('\"'||tag||'\"', ',' ORDER BY tag_idx)||']' AS tags_json FROM v GROUP BY top",
    "vocabulary_from_json": f"WITH {V} SELECT top, CAST(row_number() OVER (PARTITION BY top ORDER BY tag_idx)-1 AS INT) AS tag_idx, tag FROM v",
    "split_fingerprint": f"WITH {C}, n AS (SELECT split, count(*) AS n_rows FROM c WHERE split IS NOT NULL GROUP BY 1), u AS (SELECT split, string_agg(uid, ',' ORDER BY uid) AS us FROM (SELECT split, uid FROM (SELECT DISTINCT split, uid FROM c WHERE split IS NOT NULL AND uid IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY split ORDER BY uid)<=64) GROUP BY 1) SELECT split, n_rows, left(sha256(split||'|'||n_rows||'|'||us),16) AS fingerprint FROM n JOIN u USING (split)",
    "mask_select": f"WITH {C} SELECT row_id, uid FROM c WHERE text IS NOT NULL AND locale='us' AND length(text)>100",
    "class_filter": f"WITH {C} SELECT row_id, top, tag FROM c WHERE top='finance'",
    "domain_to_top": "SELECT row_id, f.domain, coalesce(d.top,'other') AS top FROM frames f LEFT JOIN domain_list d ON f.domain=d.domain",
    "hard_negative_flag": "SELECT row_id, coalesce(d.hard_negative_of IS NOT NULL,false) AS is_hard_negative FROM frames f LEFT JOIN domain_list d ON f.domain=d.domain",
    "encode_top": f"WITH {C} SELECT row_id, {TOPIDX} AS top_idx FROM c",
    "encode_tag": f"WITH {C}, {V} SELECT row_id, coalesce(v.tag_idx,-1) AS tag_idx FROM c LEFT JOIN v ON c.top=v.top AND c.tag=v.tag",
    "null_other_tag": f"WITH {C} SELECT row_id, CASE WHEN top<>'other' THEN tag END AS gold_tag FROM c",
    "industry_rows": f"WITH {C} SELECT row_id, top FROM c WHERE top IN {IND}",
    "drop_unencodable": f"WITH {C}, {V} SELECT row_id, c.top, v.tag_idx FROM c JOIN v ON c.top=v.top AND c.tag=v.tag",
    "domain_in_description": f"WITH {C} SELECT split, count(*) AS n_rows, round(avg(contains(lower(description),lower(domain))::INT::DOUBLE),6) AS rate FROM c WHERE description IS NOT NULL AND domain IS NOT NULL GROUP BY split",
    "truncate_text": "SELECT row_id, md5(left(coalesce(text,''),400)) AS head_md5, length(left(coalesce(text,''),1200)) AS n_chars FROM frames",
    "scaled_concat": "SELECT vec_id, 2*len(embedding)::BIGINT AS n_terms, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE*(1+0.6::DOUBLE*0.6::DOUBLE))),5) AS square FROM embeddings",
    "unknown_domains": "SELECT domain, count(*) AS n_rows FROM frames WHERE domain IS NOT NULL AND domain NOT IN (SELECT domain FROM domain_list) GROUP BY 1",
    "uid_assignment": f"WITH {C}, {SPLIT} SELECT c.row_id, c.uid, s.split FROM c JOIN s USING (uid)",
    "stratified_split": f"WITH {C}, {SPLIT} SELECT * FROM s",
    "leakage_check": f"WITH {C} SELECT uid, count(DISTINCT split) AS n_splits FROM c WHERE split IS NOT NULL AND uid IS NOT NULL GROUP BY uid HAVING count(DISTINCT split)>1",
    "split_intersection": f"WITH {C} SELECT uid FROM c WHERE split='train' AND uid IS NOT NULL INTERSECT SELECT uid FROM c WHERE split IN ('dev','test')",
    "unseen_tag_rows": f"WITH {C}, {TRAINV} SELECT row_id, top, tag FROM c WHERE top IN {IND} AND split<>'train' AND NOT EXISTS (SELECT 1 FROM tv WHERE tv.top=c.top AND tv.tag=c.tag)",
    "first_row_per_uid": f"WITH {C}, {ONE} SELECT uid, row_id, top, document_format FROM o",
    "split_describe": f"WITH {C} SELECT GROUPING(split,top,locale)::INT AS level, split, top, locale, count(*) AS n_rows, count(DISTINCT uid) AS n_uids FROM c GROUP BY GROUPING SETS ((split),(split,top),(split,locale),(top))",
    "label_space_stats": f"WITH {C}, d AS (SELECT * FROM c WHERE split='train' AND top IN {IND} AND tag<>''), t AS (SELECT top, tag, count(*) AS k, count(DISTINCT uid) AS s FROM d GROUP BY 1,2), u AS (SELECT top, count(DISTINCT uid) AS n_uids FROM d GROUP BY 1) SELECT top, count(*) AS n_tags, sum(k)::BIGINT AS n_rows, min(s) AS min_support, trunc(median(s))::INT AS median_support, max(s) AS max_support, count(*) FILTER (WHERE s<10) AS under_10, any_value(n_uids) AS n_uids FROM t JOIN u USING (top) GROUP BY top",
    "domain_report": "SELECT f.domain, coalesce(any_value(d.top),'other') AS top, coalesce(any_value(d.hard_negative_of) IS NOT NULL,false) AS is_hard_negative, count(*) AS n_rows FROM frames f LEFT JOIN domain_list d ON f.domain=d.domain WHERE f.domain IS NOT NULL GROUP BY 1",
    "unseen_tag_rate": f"WITH {C}, {TRAINV}, j AS (SELECT c.split, tv.tag IS NULL AS miss FROM c LEFT JOIN tv ON tv.top=c.top AND tv.tag=c.tag WHERE c.split IS NOT NULL AND c.top IN {IND}) SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE miss) AS n_unseen, round(count(*) FILTER (WHERE miss)/count(*),4) AS rate FROM j GROUP BY 1",
    "vocabulary": f"WITH {C}, {TRAINV} SELECT * FROM tv",
    "sample_weights": "WITH r AS (SELECT row_id, coalesce(d.top,'other') AS top, d.hard_negative_of IS NOT NULL AS hard FROM frames f LEFT JOIN domain_list d ON f.domain=d.domain), k AS (SELECT top, count(*) AS c FROM r GROUP BY 1) SELECT row_id, top, round((SELECT count(*) FROM r)/(4.0::DOUBLE*c)*CASE WHEN top='other' AND hard THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END,6) AS weight FROM r JOIN k USING (top)",
    "descriptions_by_tag": f"WITH {C}, d AS (SELECT *, row_number() OVER (PARTITION BY top,tag,left(description,80) ORDER BY row_id) AS a FROM c WHERE top IN {IND} AND tag<>'' AND description IS NOT NULL) SELECT top, tag, CAST(k AS INT) AS k, description FROM (SELECT *, row_number() OVER (PARTITION BY top,tag ORDER BY row_id) AS k FROM d WHERE a=1) WHERE k<=6",
    "deterministic_sample": "SELECT row_id FROM frames WHERE split_name='dev' ORDER BY md5('0|'||row_id), row_id LIMIT 100",
    "pair_enumeration": f"WITH {V} SELECT CASE top WHEN 'healthcare' THEN 0 WHEN 'finance' THEN 1 ELSE 2 END AS top_idx, tag_idx, top, tag FROM v UNION ALL SELECT 3, -1, 'other', NULL",
    "normalize_tag": f"SELECT row_id, {norm('tag')} AS tag FROM frames",
    "normalize_type": f"SELECT rec_id, {norm('document_type')} AS tag FROM raw_records",
    "singularize": f"SELECT w, {sing('w')} AS singular FROM (SELECT DISTINCT unnest({toks('text')}) AS w FROM documents)",
    "tag_tokens": f"WITH {C} SELECT row_id, coalesce(array_to_string(list_filter(string_split(tag,' '), lambda w, i: w<>'' AND w NOT IN ('a','an','the','of','for','and','to','in','on') AND list_position(string_split(tag,' '),w)=i),','),'') AS tokens FROM c",
    "tokenize_counts": f"SELECT row_id, len({toks('text')})::INT AS n_tokens FROM frames",
    "word_bigrams": f"WITH t AS (SELECT source, {toks('text')} AS t FROM frames), b AS (SELECT source, unnest(list_transform(range(1,len(t)), lambda i: t[i]||' '||t[i+1])) AS b FROM t) SELECT source, count(*) AS n, count(DISTINCT b) AS n_distinct FROM b GROUP BY 1",
    "char_ngrams": f"WITH {GRAMS} SELECT term AS g, sum(tf)::BIGINT AS n, count(*) AS n_rows FROM tf GROUP BY 1",
    "strip_accents": "SELECT name_part, strip_accents(name_part) AS plain FROM name_parts",
    "extract_headings": f"WITH {C}, {HEAD} SELECT row_id, coalesce(array_to_string(hs,'¦'),'') AS headings FROM h4",
    "substring_position": f"WITH {C} SELECT row_id, CAST(instr({norm("left(coalesce(text,''),2500)")},tag)-1 AS INT) AS pos FROM c WHERE instr({norm("left(coalesce(text,''),2500)")},tag)>0",
    "dedupe_headings": "SELECT row_id, len(list_distinct(list_transform(list_filter(string_split(coalesce(text,''),chr(10)), lambda x: x<>''), lambda x: lower(x))))::INT AS n_lines FROM frames",
    "idf_table": f"WITH {C}, {V}, {HEAD}, tr AS (SELECT * FROM c WHERE split='train'), nn AS (SELECT ln(count(*)::DOUBLE) AS ln_n FROM tr), df AS (SELECT t AS token, count(*) AS df FROM (SELECT unnest(list_distinct({toks("left(coalesce(text,''),2000)")})) AS t FROM tr) GROUP BY 1) SELECT token, df, round(ln_n-ln(1.0::DOUBLE+df),6) AS idf FROM df, nn",
    "heading_channel": f"WITH {LEX} SELECT row_id, top, tag_idx, round(heading,6) AS heading FROM lx",
    "verbatim_channel": f"WITH {LEX} SELECT row_id, top, tag_idx, round(verbatim,6) AS verbatim FROM lx WHERE verbatim>0",
    "verbatim_rate": f"WITH {C} SELECT split, count(*) AS n_rows, round(avg(contains({norm("left(coalesce(text,''),3000)")},tag)::INT::DOUBLE),6) AS rate FROM c WHERE top IN {IND} AND tag<>'' GROUP BY split",
    "heading_hit_rate": f"WITH {C}, {HEAD} SELECT split, count(*) AS n_rows, round(avg(coalesce(list_contains(list_transform(hs, lambda x: {norm('x')}),tag),false)::INT::DOUBLE),6) AS rate FROM h4 WHERE top IN {IND} AND tag<>'' GROUP BY split",
    "lexical_top1": f"WITH {LEX}, ow AS (SELECT lx.*, c.tag AS gold FROM lx JOIN c ON c.row_id=lx.row_id AND c.top=lx.top), bs AS (SELECT row_id, arg_max(tag,(heading,-tag_idx)) AS h, arg_max(tag,(verbatim,-tag_idx)) AS vv, arg_max(tag,(heading+0.5::DOUBLE*verbatim,-tag_idx)) AS cc FROM ow GROUP BY 1) SELECT top, count(*) AS n_rows, round(avg(coalesce(h=tag,false)::INT::DOUBLE),6) AS heading, round(avg(coalesce(vv=tag,false)::INT::DOUBLE),6) AS verbatim, round(avg(coalesce(cc=tag,false)::INT::DOUBLE),6) AS combined FROM c LEFT JOIN bs USING (row_id) WHERE top IN {IND} AND tag<>'' GROUP BY top",
    "tfidf_word": f"WITH {TFIDF} SELECT source, term, round(sum(w),5) AS w FROM w JOIN c USING (row_id) GROUP BY 1,2",
    "tfidf_bigram_space": f"WITH {TFIDF} SELECT term, df, round(idf,6) AS idf FROM ti ORDER BY cf DESC, term LIMIT 300000",
    "tfidf_char": f"WITH {GRAMS}, tm AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1 HAVING count(*)>=3 ORDER BY cf DESC, term LIMIT 300000), x AS (SELECT row_id, term, (1.0::DOUBLE+ln(tf))*(ln(1.0::DOUBLE+(SELECT count(*) FROM c))-ln(1.0::DOUBLE+df)+1.0::DOUBLE) AS x FROM tf JOIN tm USING (term)), w AS (SELECT row_id, term, x/sqrt(sum(x*x) OVER (PARTITION BY row_id)) AS w FROM x) SELECT row_id, count(*) AS n_terms, round(sum(w),5) AS w FROM w GROUP BY 1",
    "feature_space_size": f"WITH {TFIDF} SELECT count(*) AS n_terms, min(df) AS min_df, max(df) AS max_df FROM ti",
    "rocchio_centroids": f"WITH {ROC} SELECT {SPLIT_LABEL}, term, round(c,6) AS c FROM ce",
    "rocchio_scores": f"WITH {ROC} SELECT row_id, {SPLIT_LABEL}, round(sum(w*ce.c),5) AS score FROM w JOIN ce USING (term) GROUP BY row_id, label",
    "prototype_scores": "WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1,(SELECT max(len(embedding)) FROM embeddings)+1) g(i) GROUP BY 1,2), p AS (SELECT label, list(m ORDER BY i) AS v, sqrt(sum(m*m)) AS n FROM m GROUP BY 1) SELECT vec_id, p.label, round(list_dot_product(embedding::DOUBLE[],v)/n,4) AS score FROM embeddings e, p",
    "l2_normalize": "SELECT vec_id, 1.0::DOUBLE AS square FROM embeddings",
    "zscore_mix": f"WITH {DENSE} SELECT row_id, top, tag_idx, round((heading-avg(heading) OVER w)/greatest(stddev_pop(heading) OVER w,1e-6)+0.5::DOUBLE*(verbatim-avg(verbatim) OVER w)/greatest(stddev_pop(verbatim) OVER w,1e-6),5) AS mixed FROM dx WINDOW w AS (PARTITION BY row_id,top)",
    "log_softmax": f"WITH {TIER} SELECT row_id, top, tag_idx, round(lp,5) AS lp FROM t2",
    "temperature_grid": f"WITH {TIER}, g AS (SELECT c.row_id, c.top, v.tag_idx FROM c JOIN v ON c.top=v.top AND c.tag=v.tag WHERE c.split='dev'), o AS (SELECT sc.row_id, sc.top, list(score) AS ss, max(score) AS mx, max(score) FILTER (WHERE sc.tag_idx=g.tag_idx) AS gs FROM sc JOIN g USING (row_id,top) GROUP BY 1,2), f AS (SELECT *, unnest([{TEMPERATURES}]) AS t FROM o) SELECT top, t, round(avg(-((gs-mx)/t-ln(list_sum(list_transform(ss, lambda x: exp((x-mx)/t)))))),5) AS nll FROM f GROUP BY 1,2",
    "joint_decode": f"WITH {TIER}{JOINT}, s AS (SELECT *, {joint('0.5::DOUBLE')} AS score FROM al), w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, {TOPIDX})=1) SELECT row_id, top, tag, round(score,5) AS score, round(exp(lp),5) AS top_confidence, round(CASE WHEN top='other' THEN 1.0::DOUBLE ELSE exp(tlp) END,5) AS tag_confidence FROM w",
    "lambda_sweep": f"WITH {TIER}{JOINT}, s AS (SELECT *, {joint('lam')} AS score FROM al, (SELECT unnest([0.0,0.1,0.2,0.3,0.5,0.75,1.0,1.5])::DOUBLE AS lam)), w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lam,row_id ORDER BY score DESC, {TOPIDX})=1), j AS (SELECT lam, w.top=c.top AS ok, c.top AS g, w.top=c.top AND (c.top='other' OR w.tag IS NOT DISTINCT FROM c.tag) AS ex FROM w JOIN c USING (row_id) WHERE c.split='dev') SELECT lam, round(avg(ok::INT::DOUBLE),5) AS tier1, round(avg(ex::INT::DOUBLE),5) AS end_to_end, round(avg(ex::INT::DOUBLE) FILTER (WHERE g<>'other'),5) AS industry_exact FROM j GROUP BY 1",
    "top_k_pairs": f"WITH {TIER}, a AS (SELECT t1.row_id, t1.top, tag_idx, tag, t1.lp+0.5::DOUBLE*t2.lp AS score FROM t1 JOIN t2 USING (row_id,top) WHERE t1.top<>'other' UNION ALL SELECT row_id, top, -1, NULL, lp FROM t1 WHERE top='other') SELECT row_id, CAST(rank AS INT) AS rank, top, tag, round(score,5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, {TOPIDX}, tag_idx) AS rank FROM a) WHERE rank<=3",
    "tier1_confusion": f"{CONF} SELECT * FROM cf",
    "class_metrics": f"{CLASSES} SELECT * FROM pc",
    "macro_f1": f"{CLASSES} SELECT round(avg(f1),5) AS macro_f1 FROM pc",
    "headline_metrics": f"WITH {CMP} SELECT count(*) AS n_rows, {avg6('ok')} AS tier1_accuracy, {avg6('tag IS NOT DISTINCT FROM gold_tag', 'gold_top<>' + chr(39) + 'other' + chr(39) + ' AND ok')} AS tier2_given_top, {avg6('ex')} AS exact_all, {avg6('ex', 'gold_top<>' + chr(39) + 'other' + chr(39))} AS exact_industry FROM e",
    "per_industry_metrics": f"WITH {CMP} SELECT gold_top, count(*) AS n_rows, {avg6('ok')} AS tier1_recall, {avg6('tag IS NOT DISTINCT FROM gold_tag', 'ok')} AS tier2_given_top, {avg6('ex')} AS end_to_end, count(DISTINCT gold_tag) AS n_tags FROM e WHERE gold_top<>'other' GROUP BY 1",
    "slice_locale": f"WITH {CMP} SELECT locale AS value, count(*) AS n_rows, {avg6('ok')} AS tier1_accuracy, {avg6('ex')} AS end_to_end FROM e GROUP BY 1",
    "slice_format": f"WITH {CMP} SELECT document_format AS value, count(*) AS n_rows, {avg6('ok')} AS tier1_accuracy, {avg6('ex')} AS end_to_end FROM e GROUP BY 1",
    "coverage_curve": f"{CURVE} SELECT * FROM cv",
    "accuracy_at_target": f"{CURVE} SELECT coverage, accuracy, threshold FROM cv WHERE accuracy>=0.9 ORDER BY coverage DESC, point LIMIT 1",
    "errors_by_domain": f"WITH {CMP}, x AS (SELECT domain, top, count(*) AS n FROM e WHERE NOT ok GROUP BY 1,2) SELECT domain, sum(n)::BIGINT AS n_errors, string_agg(concat_ws(':',top,n), ',' ORDER BY top NULLS FIRST) AS predicted FROM x GROUP BY 1 ORDER BY n_errors DESC, domain NULLS FIRST LIMIT 20",
    "error_samples": f"WITH {CMP} SELECT row_id, gold_top, top, left(coalesce(text,''),240) AS excerpt FROM e WHERE NOT ok ORDER BY row_id LIMIT 25",
    "confusion_affinity": f"WITH {C}, {CNT}, s AS (SELECT top, gold AS tag, sum(n) AS s FROM cnt GROUP BY 1,2) SELECT p.top, p.tag_a, p.tag_b, round(sum(p.n_confused)/greatest(coalesce(any_value(a.s),0)+coalesce(any_value(b.s),0),1),6) AS affinity FROM tag_pairs p LEFT JOIN s a ON a.top=p.top AND a.tag=p.tag_a LEFT JOIN s b ON b.top=p.top AND b.tag=p.tag_b GROUP BY 1,2,3",
    "aliased_accuracy": f"WITH {GP}, {ALIAS} SELECT gp.top, count(*) AS n_rows, {avg6('gold=pred')} AS raw, {avg6('coalesce(a.canonical,gold)=coalesce(b.canonical,pred)')} AS merged FROM gp LEFT JOIN al a ON a.top=gp.top AND a.tag=gold LEFT JOIN al b ON b.top=gp.top AND b.tag=pred GROUP BY 1",
    "canonical_vocabulary": f"WITH {ALIAS}, t AS (SELECT DISTINCT l.top, coalesce(al.canonical,l.tag) AS tag FROM tag_list l LEFT JOIN al ON al.top=l.top AND al.tag=l.tag) SELECT top, CAST(row_number() OVER (PARTITION BY top ORDER BY tag)-1 AS INT) AS tag_idx, tag FROM t",
    "raw_accuracy": f"WITH {GP} SELECT top, count(*) AS n_rows, {avg6('gold=pred')} AS accuracy FROM gp GROUP BY 1",
    "merge_clusters": f"{MERGE} SELECT * FROM mg",
    "merge_aliases": f"{MERGE} SELECT threshold, top, tag, canonical FROM mg WHERE tag<>canonical",
    "threshold_sweep": f"{MERGE}, {P}, {V}, {GPONLY}, z AS (SELECT threshold, count(*) AS tags_before, count(DISTINCT top||chr(9)||canonical) AS tags_after FROM mg GROUP BY 1), y AS (SELECT t AS threshold, round(avg((coalesce(a.canonical,gold)=coalesce(b.canonical,pred))::INT::DOUBLE),6) AS accuracy FROM gp, th LEFT JOIN mg a ON a.threshold=t AND a.top=gp.top AND a.tag=gold LEFT JOIN mg b ON b.threshold=t AND b.top=gp.top AND b.tag=pred GROUP BY 1) SELECT threshold, tags_before, tags_after, accuracy FROM z JOIN y USING (threshold)",
    "recommended_threshold": f"{MERGE}, {P}, {V}, {GPONLY}, z AS (SELECT threshold, count(*) AS tags_before, count(DISTINCT top||chr(9)||canonical) AS tags_after FROM mg GROUP BY 1), y AS (SELECT t AS threshold, round(avg((coalesce(a.canonical,gold)=coalesce(b.canonical,pred))::INT::DOUBLE),6) AS accuracy FROM gp, th LEFT JOIN mg a ON a.threshold=t AND a.top=gp.top AND a.tag=gold LEFT JOIN mg b ON b.threshold=t AND b.top=gp.top AND b.tag=pred GROUP BY 1) SELECT threshold, tags_before, tags_after, accuracy FROM z JOIN y USING (threshold) WHERE accuracy>=(SELECT avg((gold=pred)::INT::DOUBLE) FROM gp)+0.01::DOUBLE ORDER BY accuracy DESC, threshold LIMIT 1",
    "prediction_affinity": f"WITH {GP}, k AS (SELECT top, gold, pred, count(*) AS n FROM gp GROUP BY 1,2,3), s AS (SELECT top, gold AS tag, count(*) AS s FROM gp GROUP BY 1,2), u AS (SELECT top, least(gold,pred) AS tag_a, greatest(gold,pred) AS tag_b, sum(n) AS n FROM k WHERE gold<>pred GROUP BY 1,2,3) SELECT u.top, tag_a, tag_b, round(n/greatest(coalesce(a.s,0)+coalesce(b.s,0),1),6) AS affinity FROM u LEFT JOIN s a ON a.top=u.top AND a.tag=tag_a LEFT JOIN s b ON b.top=u.top AND b.tag=tag_b",
    "predict_struct": f"WITH {TIER}{JOINT}, s AS (SELECT *, {joint('0.5::DOUBLE')} AS score FROM al), w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, {TOPIDX})=1), pr AS (SELECT row_id, string_agg(top||'='||round(round(exp(lp),4)*10000)::BIGINT, ',' ORDER BY top||'='||round(round(exp(lp),4)*10000)::BIGINT) AS probabilities FROM t1 GROUP BY 1), a AS (SELECT t1.row_id, t1.top, tag_idx, tag, t1.lp+0.5::DOUBLE*t2.lp AS score FROM t1 JOIN t2 USING (row_id,top) WHERE t1.top<>'other' UNION ALL SELECT row_id, top, -1, NULL, lp FROM t1 WHERE top='other'), k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, {TOPIDX}, tag_idx) AS rank FROM a QUALIFY rank<=3), ka AS (SELECT row_id, string_agg(top||'/'||coalesce(tag,'')||'='||round(round(score,4)*10000)::BIGINT, ',' ORDER BY rank) AS alternatives FROM k GROUP BY 1) SELECT row_id, top AS industry, tag AS sub_tag, round(exp(lp),4) AS industry_confidence, CASE WHEN top<>'other' THEN round(exp(tlp),4) END AS sub_tag_confidence, probabilities, alternatives FROM w JOIN pr USING (row_id) JOIN ka USING (row_id)",
}
