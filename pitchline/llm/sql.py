"""DuckDB SQL for the results of the queries that SQL can express."""

SOURCE_MIX = """
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as h
  from documents),
per as (
  select source, sum(size)::bigint as source_size, sum(size)::double * 3 as most,
         [1.0, 2.0, 3.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight
  from sizes group by source),
filled as (
  select *, most / weight as fill,
         (sum(source_size) over ()::double - (sum(most) over w - most)) / (sum(weight) over () - sum(weight) over w + weight) as level
  from per window w as (order by most / weight, source nulls last rows unbounded preceding)),
goal as (
  select source, source_size,
         coalesce(least((select arg_min(level, fill) from filled where level <= fill) * weight, most), most) as target
  from filled),
rest as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as repeats from goal),
ranked as (
  select s.source, s.h, sum(s.size) as w, any_value(r.target - r.repeats * r.source_size) as rest
  from sizes s join rest r on s.source is not distinct from r.source where s.size > 0 group by s.source, s.h),
running as (select *, sum(w) over (partition by source order by h) as upto from ranked),
cuts as (
  select source, max(h) filter (upto < rest or (upto - w < rest and (rest - upto + w) * 2 >= w)) as cut
  from running where rest > 0 group by source)
select s.doc_id, s.size, r.source_size, r.target,
       (s.size * (r.repeats + case when s.h <= c.cut then 1 else 0 end))::bigint as taken
from sizes s join rest r on s.source is not distinct from r.source
left join cuts c on s.source is not distinct from c.source
"""

#: Exact linkage through an inverted index of shingles.  Components by label propagation.
MINHASH = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') as w
  from documents),
grams as (
  select distinct doc_id, hash(g) as g from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                               else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g
    from words)),
sized as (select doc_id, count(*) as n from grams group by doc_id),
classes as (
  select doc_id, min(doc_id) over (partition by n, s1, s2) as rep from (
    select doc_id, count(*) as n, sum(g::hugeint) as s1, bit_xor(hash(g + 1)) as s2 from grams group by doc_id)),
reps as (select distinct rep from classes),
rg as (select g.doc_id, g.g from grams g join reps on reps.rep = g.doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from rg a join rg b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (
  select a, b from pairs join sized x on x.doc_id = a join sized y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
edges as (select a, b from links union all select b, a from links),
reach as (
  select rep as node, rep as root from reps
  union
  select e.b, r.root from reach r join edges e on e.a = r.node),
comp as (select node, min(root) as root from reach group by node)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, coalesce(m.root, d.doc_id) as component_id,
       coalesce(m.root, d.doc_id) = d.doc_id as kept
from documents d left join sized s on s.doc_id = d.doc_id left join classes c on c.doc_id = d.doc_id left join comp m on m.node = c.rep
"""

#: Every pair of vectors by cosine in double precision.
NEAR_VECTORS = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (
  select vec_id as node, vec_id as root from embeddings
  union
  select l.b, r.root from reach r join links l on l.a = r.node),
comp as (select node, min(root) as root from reach group by node),
deg as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, c.root as component_id, c.root = e.vec_id as kept
from embeddings e join comp c on c.node = e.vec_id left join deg d on d.a = e.vec_id
"""

#: Unigram scores of every document; the fold's checksum bit by bit.
LM_BASE = """
with bits as (
  select doc_id, flatten(list_transform(str_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) as b from documents),
folds as (
  select doc_id, xor(list_reduce([4294967295::bigint] || b, lambda s, x: case when x >= 0 then xor(s, x) when s % 2 = 1 then xor(s // 2, 3988292384) else s // 2 end), 4294967295) % 10 = 0 as held_out from bits),
tokens as (
  select d.doc_id, f.held_out, unnest(list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+'), lambda w: 'w' || w) || ['end']) as t
  from documents d join folds f on f.doc_id = d.doc_id),
counts as (select t, count(*) as c from tokens where not held_out group by t),
all_ as (select sum(c)::bigint as n, count(*) as v from counts)
select doc_id, any_value(held_out) as held_out, count(*) as n_tokens, count(c) as n_known, any_value(n) as train_tokens,
       round(sum(log10((coalesce(c, 0) + 0.1::double) / (n + 0.1::double * (v + 1)))), 4) as base_score
from tokens left join counts using (t), all_ group by doc_id
"""

PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS n FROM listed) WHERE len(w) >= n)
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang
), counts AS (
  SELECT lang, n, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, n, phrase HAVING count(*) >= 30
), cuts AS (
  SELECT lang, phrase, f AS a, n, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:n], ' ') AS rp FROM (SELECT *, unnest(range(1, n)) AS k FROM counts WHERE n >= 2)
), scored AS (
  SELECT c.*, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lp JOIN counts y ON y.lang = c.lang AND y.phrase = c.rp
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, part, max(f) AS most
  FROM (SELECT lang, f, unnest(flatten([[array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, n - m + 2)] FOR m IN range(2, n)])) AS part FROM counts WHERE n >= 3) GROUP BY lang, part
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.part = b.phrase WHERE g.most IS NULL OR 100::HUGEINT * g.most < 80::HUGEINT * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
