"""Registered queries: sources (SRC1-3), projection / order (PF1-5), splits and
batches (SP1-3, IDX), nested groups (NE1-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FRAC_DATA_IN_SAFETY, PRIMARY_BATCH_SIZE, N_EPOCHS, PRONOUN_TERMS
from ..operators.nested import (
    chop_groups,
    chunk_groups,
    expand_terms,
    flatten_chunks,
    flatten_groups,
    group_sizes,
    hard_groups,
    nest_texts,
    renest,
)
from ..operators.measures import vprob
from ..operators.prep import (
    assign_batches,
    dense_index,
    derive_split,
    objective_columns,
    order_key,
    seeded_head,
    split_safety,
    take_split,
)
from ..operators.score import lexicon_model, score_terms
from ..session import load_table, scratch_path
from ..sources.standins import conversation_groups, document_groups, primary_table
from ..sources.text import (
    apply_metadata,
    labelled_from_primary,
    read_labelled_text,
    read_metadata,
    read_text_groups,
    write_labelled_text,
    write_metadata,
)
from . import oracle as O
from .catalog import register

HEAD_N = 100
CHOP_K = 4

LABELLED_SQL = f"""SELECT CAST(doc_id AS VARCHAR) AS "acl.id", text, label, {O.derive_split('doc_id')} AS split
FROM ({O.PRIMARY})"""


@register("src1_labelled_text", LABELLED_SQL)
def src1_labelled_text(spark, sf_dir):
    """Labelled text written as CSV and read in its declared shape (acl.id, text, label, split)."""
    path = scratch_path(spark, "labelled")
    write_labelled_text(labelled_from_primary(primary_table(spark, sf_dir)), path)
    return read_labelled_text(spark, path)


@register("src2_declared_columns", LABELLED_SQL)
def src2_declared_columns(spark, sf_dir):
    """Declared-column projection of a wider table (extra columns dropped,
    missing ones fail, sensitive ones flagged)."""
    docs = load_table(spark, sf_dir, "documents")
    labels = load_table(spark, sf_dir, "labels")
    wide = docs.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("acl.id"),
        "lang",
        "source",
        "n_chars",
        "quality",
        "text",
        F.col("toxic").cast("int").alias("label"),
        derive_split(F.col("doc_id")).alias("split"),
    )
    path = scratch_path(spark, "metadata")
    write_metadata(spark, path)
    return apply_metadata(wide, read_metadata(spark, path))


GROUP_ARRAYS_SQL = (
    "SELECT conv_id AS group_id, CAST(count(*) AS INTEGER) AS n_members, list(text ORDER BY turn) AS text_groups "
    "FROM conversations GROUP BY conv_id"
)


@register("src3_text_groups", GROUP_ARRAYS_SQL)
def src3_text_groups(spark, sf_dir):
    """Text groups, one ragged array per group, read from JSON files
    (conversations by turn, written first)."""
    path = scratch_path(spark, "groups")
    nest_texts(conversation_groups(spark, sf_dir)).select("group_id", "text_groups").write.json(path)
    groups = read_text_groups(spark, path, "json")
    return groups.select("group_id", F.size("text_groups").alias("n_members"), "text_groups")


@register("pf1_take_split", f"SELECT * FROM ({LABELLED_SQL}) WHERE split = 'train'")
def pf1_take_split(spark, sf_dir):
    return take_split(labelled_from_primary(primary_table(spark, sf_dir)), "train")


@register("pf2_objective_columns", f"SELECT text, label FROM ({LABELLED_SQL}) WHERE split = 'train'")
def pf2_objective_columns(spark, sf_dir):
    return objective_columns(take_split(labelled_from_primary(primary_table(spark, sf_dir)), "train"))


@register(
    "pf3_seeded_order",
    f"""SELECT doc_id, label, {O.order_key('doc_id')} AS shuffle_key,
    row_number() OVER (ORDER BY {O.order_key('doc_id')}, doc_id) - 1 AS ord FROM ({O.PRIMARY})""",
)
def pf3_seeded_order(spark, sf_dir):
    """Seeded permutation with its dense position ``ord``."""
    df = primary_table(spark, sf_dir).select("doc_id", "label", order_key("doc_id").alias("shuffle_key"))
    return dense_index(df, ["shuffle_key", "doc_id"], "ord")


@register(
    "pf4_seeded_head",
    f"""SELECT doc_id, label, {O.order_key('doc_id')} AS shuffle_key FROM ({O.PRIMARY})
    ORDER BY shuffle_key, doc_id LIMIT {HEAD_N}""",
)
def pf4_seeded_head(spark, sf_dir):
    """Seeded sample of HEAD_N rows without replacement."""
    return seeded_head(primary_table(spark, sf_dir).select("doc_id", "label"), "doc_id", HEAD_N)


@register(
    "pf5_num_datapoints",
    f"""SELECT 'primary' AS dataset, count(*) AS num_datapoints FROM ({O.PRIMARY})
    UNION ALL SELECT 'groups_lang_source', count(DISTINCT group_id) FROM ({O.GROUPS_LS})
    UNION ALL SELECT 'groups_source', count(DISTINCT group_id) FROM ({O.GROUPS_SRC})
    UNION ALL SELECT 'groups_conversation', count(DISTINCT group_id) FROM ({O.GROUPS_CONV})""",
)
def pf5_num_datapoints(spark, sf_dir):
    """Dataset sizes at the sampling-unit grain (a group counts once). The
    labelled count and both document groupings come from one scan of the
    documents (labels joined by a size-checked broadcast)."""
    from ..sources.standins import group_id_of, labels_table

    labels, small = labels_table(spark, sf_dir)
    docs = load_table(spark, sf_dir, "documents").select(
        "doc_id", group_id_of("lang", "source").alias("g_ls"), group_id_of("source").alias("g_src")
    )
    joined = docs.join(F.broadcast(labels) if small else labels, "doc_id", "left")
    counts = joined.agg(
        F.count("label").alias("primary"),
        F.countDistinct("g_ls").alias("groups_lang_source"),
        F.countDistinct("g_src").alias("groups_source"),
    )
    names = ["primary", "groups_lang_source", "groups_source"]
    docs_rows = counts.select(
        F.explode_outer(F.array(*[F.struct(F.lit(n).alias("dataset"), F.col(n).alias("num_datapoints")) for n in names])).alias("_r")
    ).select("_r.dataset", "_r.num_datapoints")
    conv = conversation_groups(spark, sf_dir).agg(F.countDistinct("group_id").alias("num_datapoints")).select(
        F.lit("groups_conversation").alias("dataset"), "num_datapoints"
    )
    return docs_rows.unionByName(conv)


@register("sp1_split_safety", f"SELECT doc_id, label, {O.safety_part('doc_id')} AS part FROM ({O.PRIMARY})")
def sp1_split_safety(spark, sf_dir):
    """Candidate / safety split (60 % safety) of the labelled rows."""
    return split_safety(primary_table(spark, sf_dir).select("doc_id", "label"), "doc_id", FRAC_DATA_IN_SAFETY)


@register(
    "sp2_split_groups",
    f"""SELECT group_id, {O.safety_part('group_id')} AS part, count(*) AS n_members
    FROM ({O.GROUPS_LS}) GROUP BY ALL""",
)
def sp2_split_groups(spark, sf_dir):
    """The same split at group grain: members never straddle parts."""
    g = split_safety(document_groups(spark, sf_dir), "group_id", FRAC_DATA_IN_SAFETY)
    return g.groupBy("group_id", "part").agg(F.count(F.lit(1)).alias("n_members"))


@register(
    "sp3_assign_batches",
    f"""WITH e AS (SELECT p.doc_id, e.epoch FROM ({O.PRIMARY}) p, range({N_EPOCHS}) e(epoch)),
    i AS (SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, row_number() OVER (PARTITION BY epoch
          ORDER BY md5(concat_ws(':', {O.SEED_S}, 'epoch', epoch, doc_id)), doc_id) - 1 AS idx FROM e)
    SELECT doc_id, epoch, idx, idx // {PRIMARY_BATCH_SIZE} AS batch_id FROM i""",
)
def sp3_assign_batches(spark, sf_dir):
    """Mini-batches of 12 rows over 3 epochs, a new seeded order per epoch."""
    return assign_batches(primary_table(spark, sf_dir).select("doc_id"), "doc_id", PRIMARY_BATCH_SIZE, N_EPOCHS)


@register(
    "idx_dense_index",
    "SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx FROM conversations",
)
def idx_dense_index(spark, sf_dir):
    """Dense 0-based index of conversation turns in (conv_id, turn) order."""
    conv = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return dense_index(conv, ["conv_id", "turn"], "idx")


@register(
    "ne1_flatten_groups",
    """SELECT conv_id AS group_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos,
    CAST(count(*) OVER (PARTITION BY conv_id) AS INTEGER) AS n_members, text FROM conversations""",
)
def ne1_flatten_groups(spark, sf_dir):
    """Ragged group arrays flattened to members, keeping position and length."""
    return flatten_groups(nest_texts(conversation_groups(spark, sf_dir)))


def _ne2_sql():
    flat = (
        "SELECT conv_id AS group_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text "
        "FROM conversations"
    )
    s = O.scored(flat, ["group_id", "pos"], [], O.weights_values((1.0,)))
    return f"SELECT group_id, list(round(logit, 6) ORDER BY pos) AS logits FROM {s} GROUP BY group_id"


@register("ne2_renest", _ne2_sql)
def ne2_renest(spark, sf_dir):
    """Flatten -> score members in one pass -> re-nest logits in member order."""
    flat = flatten_groups(nest_texts(conversation_groups(spark, sf_dir)))
    scored = score_terms(flat.select("group_id", "pos", "text"), lexicon_model(spark, (1.0,)), key_cols=["group_id", "pos"])
    nested = renest(scored, "logit", out_col="logits")
    return nested.select("group_id", F.transform("logits", lambda x: F.round(x, 6)).alias("logits"))


@register(
    "ne2_chunked_groups",
    lambda: f"""SELECT group_id, pos // 256 AS chunk, min(pos) AS first_pos, count(*) AS n_members, list(round(logit, 6) ORDER BY pos) AS logits
    FROM {O.scored(O.GROUPS_SRC, ["group_id", "pos"], [], O.weights_values((1.0,)))} GROUP BY group_id, pos // 256""",
)
def ne2_chunked_groups(spark, sf_dir):
    """Scores of groups of any size as arrays of at most 256 members: a group is nested by many tasks."""
    scored = score_terms(document_groups(spark, sf_dir, ("source",)), lexicon_model(spark, (1.0,)), key_cols=["group_id", "pos"])
    chunks = chunk_groups(scored, "logit", size=256, out_col="logits")
    return chunks.select("group_id", "chunk", "first_pos", "n_members", F.transform("logits", lambda x: F.round(x, 6)).alias("logits"))


@register("src3_chunked_groups", O.GROUPS_SRC)
def src3_chunked_groups(spark, sf_dir):
    """Text groups of any size written as arrays of bounded members and bytes, read back and flattened."""
    path = scratch_path(spark, "chunked-groups")
    chunk_groups(document_groups(spark, sf_dir, ("source",)), "text", size=256, max_bytes=1 << 20).write.parquet(path)
    return flatten_chunks(spark.read.parquet(path), "texts", "text")


@register(
    "ne3_group_sizes",
    f"""SELECT grouping, n_members, count(*) AS n_groups FROM (
      SELECT 'conversation' AS grouping, group_id, count(*) AS n_members FROM ({O.GROUPS_CONV}) GROUP BY group_id
      UNION ALL SELECT 'lang_source', group_id, count(*) FROM ({O.GROUPS_LS}) GROUP BY group_id
      UNION ALL SELECT 'source', group_id, count(*) FROM ({O.GROUPS_SRC}) GROUP BY group_id)
    GROUP BY grouping, n_members""",
)
def ne3_group_sizes(spark, sf_dir):
    """Group-size profiles of the three group stand-ins; both document
    groupings come from one scan (each document emits one row per grouping)."""
    from ..sources.standins import group_id_of

    docs = load_table(spark, sf_dir, "documents")
    keyed = docs.select(
        F.explode_outer(
            F.array(
                F.struct(F.lit("lang_source").alias("grouping"), group_id_of("lang", "source").alias("group_id")),
                F.struct(F.lit("source").alias("grouping"), group_id_of("source").alias("group_id")),
            )
        ).alias("_g")
    ).select("_g.grouping", "_g.group_id")
    doc_sizes = keyed.groupBy("grouping", "group_id").agg(F.count(F.lit(1)).alias("n_members"))
    doc_prof = doc_sizes.groupBy("grouping", "n_members").agg(F.count(F.lit(1)).alias("n_groups"))
    conv = group_sizes(conversation_groups(spark, sf_dir)).select(F.lit("conversation").alias("grouping"), "n_members", "n_groups")
    return conv.unionByName(doc_prof)


@register(
    "ne4_chop_groups",
    f"""SELECT group_id, pos, CAST(rank AS INTEGER) AS rank FROM (SELECT group_id, pos,
      row_number() OVER (PARTITION BY group_id ORDER BY pos) AS rank FROM ({O.GROUPS_LS})) WHERE rank <= {CHOP_K}""",
)
def ne4_chop_groups(spark, sf_dir):
    """Each (lang, source) group capped at its first CHOP_K members."""
    return chop_groups(document_groups(spark, sf_dir).select("group_id", "pos"), CHOP_K)


def _ne5_sql():
    m = O.scored(O.GROUPS_LS, ["group_id", "pos"], [], O.weights_values((1.0,)))
    return f"""WITH v AS (SELECT group_id, count(*) AS n_members, var_samp({O.sigmoid('logit')}) AS vprob
    FROM {m} GROUP BY group_id),
    c AS (SELECT quantile_cont(vprob, 0.9) AS cut FROM v)
    SELECT group_id, n_members, round(vprob, 6) AS vprob FROM v, c WHERE vprob >= cut"""


@register("ne5_hard_groups", _ne5_sql)
def ne5_hard_groups(spark, sf_dir):
    """Groups at or above the 90th percentile of within-group variance."""
    members = score_terms(document_groups(spark, sf_dir), lexicon_model(spark, (1.0,)), key_cols=["group_id", "pos"])
    v = vprob(members).select("group_id", "n_members", "vprob")
    return hard_groups(v, "vprob", 0.9).select("group_id", "n_members", F.round("vprob", 6).alias("vprob"))


def _ne6_sql():
    terms = ", ".join(f"({i}, {O.q(t)})" for i, t in enumerate(PRONOUN_TERMS))
    return f"""SELECT d.doc_id AS group_id, CAST(t.pos AS INTEGER) AS pos, t.term,
    regexp_replace(d.text, '\\bhe\\b', t.term, 'gi') AS text
    FROM documents d, (VALUES {terms}) AS t(pos, term) WHERE regexp_matches(d.text, '\\bhe\\b', 'i')"""


@register("ne6_expand_terms", _ne6_sql)
def ne6_expand_terms(spark, sf_dir):
    """Counterfactual groups: documents with the word "he", pronoun swapped."""
    return expand_terms(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
