"""Queries of the numbered operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe, conversation_repair, embedding_dedup, hard_negatives, html_text, language_id, line_dedup, mixing, pii, quality, simhash, token_counts, toxicity
from logloom.llm.common import table

TOKENIZER = "word_bpe_49k.json"
#: Whole weights of the mixing tree; a value that is not listed weighs 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 2, "d2": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
SHARE, EPOCHS, SEED = 0.5, 2, 11


def domain(source: str = "source") -> Column:
    """Stand-in for a domain: the number in the source's name modulo 4."""
    number = F.expr(f"try_cast(regexp_extract({source}, '([0-9]+)', 1) as bigint)")
    return F.concat(F.lit("d"), F.coalesce((number % 4).cast("string"), F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", "fingerprint", "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, SHARE, EPOCHS, SEED, domain())
    return taken.select("doc_id", F.col("mix_epoch").cast("long").alias("epoch"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_budget").alias("leaf_budget"))


def _level(depth: int) -> str:
    """SQL of one level of budgets: `fits` children get their capacity, the others share what is left by weight."""
    path = ["domain", "lang", "source"][:depth]
    parent, own = ", ".join(path[:-1]) or "''", ", ".join(path)
    weight = " ".join(f"when {path[-1]} = '{k}' then {w}" for k, w in WEIGHTS.get(path[-1], {}).items())
    join = f"join l{depth - 1} p using ({', '.join(path[:-1])})" if depth > 1 else "cross join l0 p"
    return f"""
n{depth} as (select {own}, sum(tokens) * {EPOCHS} as capacity, {f"case {weight} else 1 end" if weight else "1"}::bigint as weight from leaves group by {own}),
s{depth} as (select n.*, p.budget, coalesce(sum(capacity) over (w rows between unbounded preceding and 1 preceding), 0) as filled, sum(weight) over (w rows between current row and unbounded following) as open
  from n{depth} n {join} window w as (partition by {parent} order by capacity::double / weight, weight, capacity, {path[-1]})),
f{depth} as (select *, capacity::hugeint * open <= weight::hugeint * (budget - filled) as fits from s{depth}),
e{depth} as (select *, sum(case when fits then capacity else 0 end) over (partition by {parent}) as used, sum(case when fits then 0 else weight end) over (partition by {parent}) as others from f{depth}),
l{depth} as (select {own}, (case when fits then capacity else greatest(budget - used, 0)::hugeint * weight // greatest(others, 1) end)::bigint as budget from e{depth})"""


OP3_SQL = f"""with docs as (
  select doc_id, concat('d', coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) as bigint) % 4, null)::varchar) as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
    coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::bigint as tokens from documents),
leaves as (select domain, lang, source, sum(tokens)::bigint as tokens from docs group by all),
l0 as (select least(floor(sum(tokens) * {SHARE}::double)::bigint, sum(tokens) * {EPOCHS}) as budget from leaves),{_level(1)},{_level(2)},{_level(3)},
plan as (select domain, lang, source, l3.budget, tokens as leaf_tokens, case when tokens > 0 then least(l3.budget // tokens, {EPOCHS}) else 1 end as whole from leaves join l3 using (domain, lang, source)),
ordered as (select docs.*, budget, whole, budget - whole * leaf_tokens as rest,
  sum(tokens) over (partition by domain, lang, source order by md5(concat('{SEED}:', whole::int, ':', doc_id)), doc_id rows unbounded preceding) as upto from docs join plan using (domain, lang, source)),
counted as (select *, whole + case when whole < {EPOCHS} and upto <= rest then 1 else 0 end as times from ordered)
select doc_id, unnest(range(times::bigint)) as epoch, tokens as n_tokens, budget as leaf_budget from counted"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    ids = F.array_join("ids", " ")
    return encoded.select("doc_id", *more, F.size("ids").cast("long").alias("n_tokens"), sha256(ids).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"))


def edits(text: str = "text") -> Column:
    """Three edits of a text: a cut in its first third, words put in at its middle, its last characters replaced."""
    n = F.coalesce(F.length(text), F.lit(0))
    edit = lambda at, cut, put: F.struct(at.cast("int").alias("at"), F.lit(cut).alias("cut"), F.lit(put).alias("put"))
    return F.array(edit(F.floor(n / 3), 25, ""), edit(F.floor(n / 2), 0, " [two words] "), edit(F.greatest(n - 8, F.lit(0)), 6, "end"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.recount(table(spark, sf_dir, "documents"), edits(), public_tokenizers.path(TOKENIZER), keep=())
    counts = {"n_before": "n_before", "n_after": "n_after", "encoded": "n_chars_encoded", "n_chars": "n_chars_after"}
    return counted.select("doc_id", *[F.col(k).cast("long").alias(v) for k, v in counts.items()])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


OP8_SQL = f"""with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (select *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{line_dedup.UPPER}', '{line_dedup.LOWER}') as key from lines),
common as (select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select k.*, c.key is not null and k.doc_id <> c.keeper as lost from keyed k left join common c using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (lost)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256 from marked group by doc_id"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an id is divisible by 7 the label is moved on by one, so that close rows of another label exist."""
    given = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(given, F.col("vec_id") % 100 == 0)


OP11_SQL = """with r as (select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, id))::int as rank, id as negative_id, positive_score, score as negative_score
  from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score)
select * from n where rank <= 5"""


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, sha256(pii.listed(F.col("base"))).alias("base_sha256"), pii.listed(F.concat("base", "added")).alias("spans"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    edits, summary = conversation_repair.repair(conversation_repair.damaged(given))
    every = given.select(F.col("conv_id").alias("conv")).distinct()
    whole = conversation_repair.together(every, summary, conversation_repair.digests(edits))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select(F.col("conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", sha256(F.lit(""))).alias("repaired_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_simhash, op2_quality, op3_mixing, op4_bpe, op5_token_counts, op6_language_id, op7_embedding_dedup, op8_line_dedup, op9_toxicity, op10_html, op11_hard_negatives, op12_pii, op13_conversation_repair, pipeline]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op8_line_dedup": OP8_SQL, "op11_hard_negatives": OP11_SQL}
