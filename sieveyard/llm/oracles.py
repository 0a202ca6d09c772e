"""The same queries in DuckDB's SQL, where SQL can say them: by all pairs and whole sets, for small tables."""

BLANKS = r"[\x20\x09-\x0D]+"
WORDS = "list_filter(string_split_regex({text}, '" + BLANKS + "'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: From links ``l(a, b)``: each id with the smallest id that it reaches, among ``ids(id)``.
REACHED = """e as (select a, b from l union select b, a from l),
reached as (select id as node, id as root from ids union select e.b, r.root from reached r join e on e.a = r.node where e.b > r.root),
components as (select node, min(root) as component_id from reached group by node)"""

NEAR_DUPLICATES = f"""with recursive w as (select doc_id, {WORDS.format(text=LOWER)} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
ids as (select distinct doc_id as id from documents),
{REACHED}
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, c.component_id = d.doc_id as kept from documents d left join n using (doc_id) join components c on c.node = d.doc_id"""

SUBSTRING_DUPLICATES = f"""with w as (select doc_id, {WORDS.format(text="coalesce(text, '')")} as w from documents),
v as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from w)),
f as (select g, min({{'d': doc_id, 'i': i}}) as f from v group by g),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as pos from v join f using (g) where f.f.d <> doc_id or f.f.i <> i),
each as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from w),
kept as (select doc_id, string_agg(word, ' ' order by pos) as t from each anti join gone using (doc_id, pos) group by doc_id),
k as (select doc_id, count(*) as n from gone group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(k.n, 0) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256 from w left join kept using (doc_id) left join k using (doc_id)"""

#: Vectors without null or non-finite components, in double precision.
GOOD = """good as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where embedding is not null and vec_id is not null
and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0)"""

EMBEDDING_DUPLICATES = f"""with recursive {GOOD}, u as (select vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from good where len(list_filter(v, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id < b.vec_id and len(a.u) = len(b.u) where list_dot_product(a.u, b.u) >= 0.9),
ids as (select vec_id as id from embeddings),
{REACHED},
n as (select a as vec_id, count(*) as n from e group by a)
select x.vec_id, coalesce(n.n, 0) as n_links, c.component_id, c.component_id = x.vec_id as kept from embeddings x left join n using (vec_id) join components c on c.node = x.vec_id"""

EXACT_TOPK = f"""with {GOOD}, i as (select vec_id, list_transform(v, lambda x: cast(floor(64 * x) as bigint)) as i from good),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.i, c.i), lambda x: x[1] * x[2])) as score from i q, i c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, cast(rank as int) as rank, vec_id, cast(score as bigint) as score from r where rank <= 20"""
