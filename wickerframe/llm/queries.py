"""The registered queries of this subpackage: thin calls of the operators with production parameters, and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, quality_model, toxicity
from .exact_dedup import exact_dedup
from .html_extract import extract
from .line_dedup import LONG_WORDS, line_dedup
from .mixing import mix
from .ngram_jaccard import jaccard_components
from .quality_rules import BOILERPLATE, CLOSED, quality_rules
from .url_filter import RULES, filter_urls, rules_frame


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def tokenizer_file() -> str:
    """Content of the public tokenizer that the queries use; the operators take any such file's content."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    return bpe.digests(docs, tokenizer_file())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity_model(docs, sf_dir))
    held_out = ~F.coalesce(toxicity.in_training_fold(F.col("doc_id")), F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def toxicity_model(docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Fitted on the labels of the training fold."""
    labels = _table(docs.sparkSession, sf_dir, "labels").where(toxicity.in_training_fold(F.col("doc_id")))
    return toxicity.fit(docs, labels)


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weights, _ = quality_model.fit(docs)
    return quality_model.quality(docs, weights)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted", F.char_length("clean_text").cast("long").alias("n_chars_left"), F.sha2("clean_text", 256).alias("clean_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).drop("clean_text")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), rules_frame(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_ngram_jaccard, op2_exact_dedup, op3_bpe, op4_toxicity, op5_quality_model, op6_html_extraction, op7_line_dedup, op8_quality_rules, op9_mixing, op10_url_filter)
    return {f.__name__: f for f in named}


_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"

_OP1 = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents),
g as (select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
s as (select distinct doc_id, s from g),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
l as (select a, b from i join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
e as (select a, b from l union all select b, a from l),
r(v, m) as (select doc_id, doc_id from documents union select e.a, r.m from r join e on e.b = r.v where r.m < e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.m) as component_id
from documents d left join n on n.doc_id = d.doc_id join r on r.v = d.doc_id group by d.doc_id, n.n
"""

_OP2 = rf"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from n
"""

_OP7 = rf"""
with d as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as l from documents),
r as (select doc_id, unnest(l) as raw, generate_subscripts(l, 1) as p from d),
w as (select doc_id, raw, p, regexp_replace(regexp_replace(raw, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+', ' ', 'g') as line from r),
c as (select doc_id, p, row_number() over (partition by doc_id order by p) as i, line, len(regexp_extract_all(line, '{_WORD}')) as n from w where line != ''),
f as (select doc_id, i, line as one, n as n1, line || chr(10) || lead(line) over o as two, n + lead(n) over o as n2, line || chr(10) || lead(line) over o || chr(10) || lead(line, 2) over o as three
      from c window o as (partition by doc_id order by i)),
g as (select doc_id, i, 1 as span, one as run from f where n1 >= {LONG_WORDS} union all select doc_id, i, 2, two from f where n2 >= {LONG_WORDS} union all select doc_id, i, 3, three from f where three is not null),
x as (select doc_id, i, span, row_number() over (partition by span, run order by doc_id, i) as k from g),
gone as (select distinct doc_id, unnest(range(i, i + span)) as i from x where k > 1),
gp as (select c.doc_id, c.p from c join gone on c.doc_id = gone.doc_id and c.i = gone.i),
s as (select r.doc_id, string_agg(r.raw, chr(10) order by r.p) as t from r left join gp on r.doc_id = gp.doc_id and r.p = gp.p where gp.p is null group by r.doc_id),
n as (select doc_id, count(*) as n from c group by doc_id),
m as (select doc_id, count(*) as m from gp group by doc_id),
e as (select d.doc_id, coalesce(n.n, 0) as n_lines, coalesce(m.m, 0) as n_deleted, case when d.text is not null then coalesce(s.t, '') end as t
      from d left join n on n.doc_id = d.doc_id left join m on m.doc_id = d.doc_id left join s on s.doc_id = d.doc_id)
select doc_id, n_lines, n_deleted, length(t) as n_chars_left, sha256(t) as clean_sha256 from e
"""

_OP8 = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '{_WORD}') as w from d),
g as (select r, unnest(range(1, len(w) - 6)) as i, w from w where len(w) >= 8),
g8 as (select r, i, array_to_string(w[i:i+7], ' ') as s from g),
hit as (select r, i from (select r, i, count(*) over (partition by r, s) as c from g8) where c > 1),
cov as (select r, sum(least(8, coalesce(nxt - i, 8))) as n from (select r, i, lead(i) over (partition by r order by i) as nxt from hit) group by r),
l0 as (select r, unnest(string_split(t, chr(10))) as line from d),
l as (select r, line, regexp_extract_all(line, '{_WORD}') as lw from l0 where regexp_matches(line, '{_WORD}')),
lf as (select r, line, len(lw) as n,
    len(regexp_extract_all(line, '[#*$%&|<>]')) as sym,
    len(list_filter(lw, lambda x: regexp_full_match(x, '\p{{Lu}}{{2,}}[^\p{{L}}]*!'))) as up,
    len(list_filter(range(1, len(lw)), lambda i: lw[i] = lw[i + 1])) as st,
    len(list_filter(lw, lambda x: regexp_matches(x, '^\p{{Lu}}'))) as cap,
    not regexp_matches(line, '{CLOSED.replace("'", "''")}') as op,
    regexp_matches(lower(line), '{"|".join(BOILERPLATE).replace("'", "''")}') as bp from l),
la as (select r, count(*) - count(distinct line) as dup,
    sum(case when sym > 0.3 * n or (n >= 5 and up > 0.6 * n) or (n >= 10 and st > 0.4 * n) or (n <= 25 and bp) or (op and (n >= 8 or (n >= 3 and cap = n))) then n else 0 end) as lost
  from lf group by r),
a as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, coalesce(dup, 0)::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words, coalesce(lost, 0)::bigint as lost_words
  from w left join cov using (r) left join la using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and lost_words <= 0.5 * n_words as kept, lost_words
from b
"""

_OP9 = rf"""
with d as (select doc_id, source, coalesce(text, '') as t, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as size from documents),
k as (select doc_id, source, size,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint::double + 0.5) / 281474976710656.0)
    / (case when size > 0 then greatest(0.1::double, 1.0::double - len(regexp_extract_all(t, '[#*$%&|<>!]'))::double / size) else 0.1::double end) as key from d),
p as (select source, sum(size)::bigint as source_size from k group by source),
q as (select *, 2.0::double * source_size as cap, (case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end)::double as weight,
      row_number() over (order by source is null, source) - 1 as pos from p),
v as (select *, (1.5::double * (sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / weight, pos rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by cap / weight, pos rows between current row and unbounded following) as level from q),
c as (select arg_min(level, cap / weight) as common from v where weight * level < cap),
g as (select source, source_size, case when weight * level >= cap then cap else weight * (select common from c) end as target from v),
h as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from g),
r as (select k.doc_id, k.size, h.source_size, h.target, h.epochs, h.target - h.epochs * h.source_size
      - coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows between unbounded preceding and 1 preceding), 0) as remain
      from k join h on k.source is not distinct from h.source)
select doc_id, size, source_size, target,
       (epochs * size + (case when remain > 0 then least(size, greatest(0, round(remain)::bigint)) else 0 end))::bigint as taken
from r
"""

_OP10 = r"""
with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
rules(verdict, r_host, r_path) as (values %s),
m as (select page_id, host, path, verdict, r_host || r_path as rule, row_number() over (partition by page_id order by length(r_host || r_path) desc, length(r_host) desc, verdict desc) as k
      from u join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
select u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') as verdict
from u left join m on u.page_id = m.page_id and m.k = 1
""" % ", ".join(str(r) for r in RULES)


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": _OP1, "op2_exact_dedup": _OP2, "op7_line_dedup": _OP7, "op8_quality_rules": _OP8, "op9_mixing": _OP9, "op10_url_filter": _OP10}
