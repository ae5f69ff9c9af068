"""The registered queries of the text operators, thin over the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import balanced_lp, decontam, language_crf, media_sequences as media, mixture, paragraph_dedup, template_html, toxicity_rnn, trie_join, url_rules
from tidemark.llm.common import table

#: Fixed by the contract.
URL_RULES = [
    url_rules.Rule("org/", "allow"),
    url_rules.Rule("example.org/es/", "block"),
    url_rules.Rule("example.org/en/1", "block"),
    url_rules.Rule("com/fr/", "allow"),
    url_rules.Rule("com/de/", "block"),
]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_lp.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_template_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def _fold(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_crf.identify(docs, _fold(4) != 2)
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "shard")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is a page whose lines are paragraphs, with a figure in the midst of them that refers to the payload of
    the whole text. What is returned was read back from the media table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2(media.padded(F.col("text")), 256)
    found = media.features(media.store(docs.select(digest.alias("digest"), media.padded(F.col("text")).alias("payload"))))
    escaped = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.split(escaped, "\n")
    half = F.floor(F.size(lines) / 2).cast("int")
    told = lambda some: F.concat(F.lit("<p>"), F.array_join(some, "</p><p>"), F.lit("</p>"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure>"))
    html = F.concat(told(F.slice(lines, F.lit(1), half)), figure, told(F.slice(lines, half + 1, F.size(lines))))
    pages = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), html.alias("html"))
    hot = media.references(docs.select(digest.alias("digest")), docs.count())
    rows = media.resolve(media.parse_sequences(pages), found, hot).where("kind = 'media'")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "n_items", "caption")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's shingles and threshold."""
    docs = trie_join.TrieJoin(table(spark, sf_dir, "documents"), k=4, percent=85).documents()
    return docs.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.judged(decontam.find(docs, table(spark, sf_dir, "benchmark")))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity_rnn.classify(docs, table(spark, sf_dir, "labels"), _fold(5) != 0)
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more: shorter ones are licence lines and phrases, which stay."""
    return paragraph_dedup.find(table(spark, sf_dir, "documents"), report_from=50)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_template_html, op3_language_crf, op4_mixture, op5_media, op6_url_rules, op7_ngram_join, op8_decontam, op9_toxicity, op10_paragraph_dedup)}

_U = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_L = "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "op6_url_rules": f"""
with u as (
  select page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_U}', '{_L}'), '') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
r(rule, verdict) as (values ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
s as (select rule, verdict, split_part(rule, '/', 1) as h, substr(rule, strpos(rule, '/')) as p from r),
m as (
  select u.page_id, max_by(s.rule, length(s.rule)) as rule, max_by(s.verdict, length(s.rule)) as verdict
  from u join s on (u.host = s.h or ends_with(u.host, '.' || s.h)) and starts_with(u.path, s.p)
  group by u.page_id)
select u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') as verdict
from u left join m using (page_id)""",
    "op4_mixture": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    md5('mix:' || doc_id) as key from documents),
n as (select source, sum(size)::bigint as n, row_number() over (order by source nulls last) - 1 as i from d group by source),
w as (select *, case i % 3 when 0 then 3 when 1 then 1 else 2 end as w, sum(n) over () * 1.5::double as total from n),
c as (
  select *, (total - coalesce(sum(2 * n) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level
  from w window b as (order by 2 * n / w, i rows between unbounded preceding and 1 preceding)),
g as (select source, n, i, least(2.0 * n, w * (select level from c where level < 2 * n / w order by 2 * n / w, i limit 1)) as target, total from c),
q as (select source, i, k, target / (2 * k - 1) as q from (select source, i, target, unnest(generate_series(1, (target / 32)::bigint + 3)) as k from g where target > 0)),
r as (select source, k, row_number() over (order by q desc, i) as rank, (select (max(total) * 2 + 32)::bigint // 64 from g) as blocks from q qualify rank <= blocks),
s as (select source, count(*) * 32 as cut from r group by source),
p as (select *, coalesce(sum(size) over (partition by source order by key rows between unbounded preceding and 1 preceding), 0) as first_word from d)
select p.doc_id, p.size::bigint as size, g.n as source_size, g.target,
  (greatest(0, least(p.size, coalesce(s.cut, 0) - first_word)) + greatest(0, least(p.size, coalesce(s.cut, 0) - first_word - g.n)))::bigint as taken,
  case when p.size > 0 then ((r.rank * 24 - 1) // r.blocks)::int end as shard
from p join g on p.source is not distinct from g.source left join s on p.source is not distinct from s.source
  left join r on p.source is not distinct from r.source and r.k = first_word // 32 + 1""",
    "op8_decontam": rf"""
with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_U}', '{_L}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), '{_U}', '{_L}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
v as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win
  from (select *, unnest(generate_series(1, greatest(1, len(w) - 9))) as i from b where len(w) > 0)),
x as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from t, (select distinct n from v))),
h as (select x.doc_id, x.n, x.i, v.item_id from x join v on x.n = v.n and x.win = v.win),
c as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as j from h) group by doc_id),
k as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from h) group by doc_id)
select t.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from t left join c using (doc_id) left join k using (doc_id)""",
    "op7_ngram_join": rf"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_U}', '{_L}'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g
  from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) as i from t where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
e as (select x.doc_id as a, y.doc_id as b from g x join g y on x.g = y.g and x.doc_id <> y.doc_id join n p on p.doc_id = x.doc_id join n q on q.doc_id = y.doc_id
  group by x.doc_id, y.doc_id, p.n, q.n having 100 * count(*) >= 85 * (p.n + q.n - count(*))),
r as (select doc_id as a, doc_id as b from t union select r.a, e.b from r join e on r.b = e.a),
c as (select a as doc_id, min(b) as component_id from r group by a)
select t.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id from t join c using (doc_id) left join n using (doc_id)""",
}
