"""Registered queries: (spark, sf_dir) -> DataFrame, one per operator group.

Each reads the driver's tables and runs the library's operators over the
whole tables.  Double outputs are rounded to 6 decimals at the end so the
oracle comparison is insensitive to summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from docsift.operators import corpus as B
from docsift.operators import tokens as C
from docsift.plans import bindings as bind
from docsift.session import cut_lineage
from docsift.sources.corpus import documents_corpus


def r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def q_clean_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return bind.clean_documents(spark, sf).select("doc_id", "title", "abstract", "title_abstract")


def q_before_view(spark, sf):
    return B.before_view(bind.clean_documents(spark, sf))


def q_ws_normalise(spark, sf):
    return B.normalise_whitespace(documents_corpus(spark, sf)).select("doc_id", "title", "abstract")


def q_dedupe_exact(spark, sf):
    return B.dedupe_exact(bind.clean_documents(spark, sf)).select("doc_id")


def q_after_view(spark, sf):
    return C.after_view(bind.clean_documents(spark, sf))


def q_doc_term_freq(spark, sf):
    return C.doc_term_freq(bind.clean_documents(spark, sf))


def q_top10_words(spark, sf):
    return C.top_words(bind.clean_documents(spark, sf), 10)


def q_word_counts(spark, sf):
    return C.word_counts(bind.clean_documents(spark, sf))


def q_token_audit(spark, sf):
    return C.token_audit(bind.clean_documents(spark, sf))


def q_truncate_tokens(spark, sf):
    return C.truncate_tokens(bind.clean_documents(spark, sf), 512)


def q_token_distribution(spark, sf):
    return r6(C.token_distribution(C.token_audit(bind.clean_documents(spark, sf))))


def q_coherence_tokens(spark, sf):
    return (C.coherence_tokens(bind.clean_documents(spark, sf))
            .select("doc_id", F.size("tokens").cast("long").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens")))


QUERIES = {
    "clean_corpus": q_clean_corpus,
    "before_view": q_before_view,
    "ws_normalise": q_ws_normalise,
    "dedupe_exact": q_dedupe_exact,
    "after_view": q_after_view,
    "doc_term_freq": q_doc_term_freq,
    "top10_words": q_top10_words,
    "word_counts": q_word_counts,
    "token_audit": q_token_audit,
    "token_distribution": q_token_distribution,
    "truncate_tokens": q_truncate_tokens,
    "coherence_tokens": q_coherence_tokens,
}


# --- topics (F), sweep-keyed by min_cluster_size over the class labels ---------------
from docsift.operators import coherence as H  # noqa: E402
from docsift.operators import quality as G  # noqa: E402
from docsift.operators import topics as T  # noqa: E402
from docsift.operators.tokens import doc_term_freq as _dtf  # noqa: E402

KEYS = ["min_cluster_size"]


def _model(spark, sf, with_words=True, with_ct=True):
    """(clean, assignments, texts to count, c-TF-IDF, topic words, held); what several later steps read is a table.

    Without `with_ct` the c-TF-IDF is not one: the words are ranked as it is computed, which is its only use.
    """
    clean = bind.clean_documents(spark, sf)
    assign = cut_lineage(T.topic_ids(cut_lineage(bind.labels_by_setting(clean)), KEYS))
    held = T._held(assign, KEYS)
    toks = C.doc_texts(clean)
    ct = T.ctfidf(assign, toks, KEYS, held)
    ct = cut_lineage(ct) if with_ct else ct
    words = cut_lineage(T.topic_words(ct, 10, KEYS)) if with_words else None
    return clean, assign, toks, ct, words, held


def _topic_model(spark, sf):
    """(clean, assignments, counts by document, c-TF-IDF, topic words)."""
    clean, assign, _, ct, words, _ = _model(spark, sf)
    return clean, assign, _dtf(clean), ct, words


def _assign(spark, sf):
    return T.topic_ids(cut_lineage(bind.labels_by_setting(bind.clean_documents(spark, sf))), KEYS)


def _words(spark, sf):
    """(clean, assignments, topic words, held)."""
    clean, assign, _, _, words, held = _model(spark, sf, with_ct=False)
    return clean, assign, words, held


def q_topic_ids(spark, sf):
    return _assign(spark, sf)


def q_ctfidf(spark, sf):
    return r6(_model(spark, sf, False)[3])


def q_topic_words(spark, sf):
    return r6(_words(spark, sf)[2])


def q_topic_info(spark, sf):
    _, assign, words, _ = _words(spark, sf)
    return T.topic_info(assign, words, KEYS)


def q_topic_freq(spark, sf):
    return T.topic_freq(_assign(spark, sf), KEYS)


def q_doc_assignments(spark, sf):
    clean = bind.clean_documents(spark, sf)
    return T.doc_assignments(_assign(spark, sf), clean, KEYS)


def q_titles_report(spark, sf):
    clean = bind.clean_documents(spark, sf)
    return T.titles_report(_assign(spark, sf), clean, KEYS)


def q_representative_docs(spark, sf):
    _, assign, toks, ct, _, held = _model(spark, sf, False)
    return r6(T.representative_docs(ct, toks, assign, 3, KEYS, held))


def q_topic_diff(spark, sf):
    clean, assign, words, held = _words(spark, sf)
    toks2 = C.coherence_texts(clean, "title_abstract")
    words2 = T.topic_words(T.ctfidf(assign, toks2, KEYS, held), 10, KEYS)
    return T.topic_diff(words, words2, 5, None, KEYS)


def q_label_prompt(spark, sf):
    clean, assign, toks, ct, words, held = _model(spark, sf)
    reps = T.representative_docs(ct, toks, assign, 3, KEYS, held)
    return T.label_prompt(words, reps, clean, keys=KEYS)


def q_topic_labels(spark, sf):
    return T.topic_labels(_words(spark, sf)[2], keys=KEYS)


def q_label_changes(spark, sf):
    _, assign, words, _ = _words(spark, sf)
    old = T.topic_info(assign, words, KEYS).select(*KEYS, "topic", F.col("name").alias("label"))
    return T.label_changes(old, T.topic_labels(words, keys=KEYS), KEYS)


def q_topics_to_show(spark, sf):
    return T.topics_to_show(_assign(spark, sf), 17, KEYS)


def q_barchart_data(spark, sf):
    return r6(T.barchart_data(_words(spark, sf)[2], keys=KEYS))


def q_topic_similarity(spark, sf):
    return r6(T.topic_similarity(_model(spark, sf, False)[3], KEYS))


def q_heatmap_k(spark, sf):
    return T.heatmap_k(_assign(spark, sf), keys=KEYS)


# --- coherence (H) ---------------------------------------------------------------------
def _coh(spark, sf):
    clean, assign, words, _ = _words(spark, sf)
    toks = C.coherence_texts(clean)
    lists = cut_lineage(H.topic_word_lists(words, 10, KEYS))
    dv = cut_lineage(H.doc_vocab(toks, lists, KEYS))
    return clean, assign, words, toks, lists, dv


def q_word_df(spark, sf):
    *_, dv = _coh(spark, sf)
    return H.word_df(dv, KEYS)


def q_pair_df(spark, sf):
    *_, lists, dv = _coh(spark, sf)
    return H.pair_df(dv, lists, KEYS)


def q_npmi(spark, sf):
    _, _, words, toks, _, dv = _coh(spark, sf)
    return r6(H.npmi_umass(toks, words, 10, KEYS, dv, ("npmi",)))


def q_umass(spark, sf):
    _, _, words, toks, _, dv = _coh(spark, sf)
    return r6(H.npmi_umass(toks, words, 10, KEYS, dv, ("umass",)))


def q_coherence_summary(spark, sf):
    _, assign, words, toks, _, dv = _coh(spark, sf)
    per = H.npmi_umass(toks, words, 10, KEYS, dv)
    return r6(H.coherence_summary(per, assign, KEYS))


# --- quality (G) -----------------------------------------------------------------------
def q_size_metrics(spark, sf):
    return r6(G.size_metrics(bind.labels_by_setting(bind.clean_documents(spark, sf)), KEYS))


def _vec(spark, sf):
    v = bind.vectors(spark, sf)
    return v.select("doc_id", "cluster"), v.select("doc_id", "vec")


def q_silhouette_cosine(spark, sf):
    lab, vec = _vec(spark, sf)
    return r6(G.silhouette_cosine(lab, vec))


def q_davies_bouldin(spark, sf):
    lab, vec = _vec(spark, sf)
    return r6(G.davies_bouldin(lab, vec))


def q_calinski_harabasz(spark, sf):
    lab, vec = _vec(spark, sf)
    return r6(G.calinski_harabasz(lab, vec))


def q_ari_vi_adjacent(spark, sf):
    return r6(G.agreement(bind.labels_by_setting(bind.clean_documents(spark, sf))))


def _runs(spark, sf):
    rl = bind.bootstrap_labels(bind.clean_documents(spark, sf))
    return rl.select(*KEYS, "run", "doc_id", "cluster")


def q_consensus_pairs(spark, sf):
    return G.consensus_histogram(_runs(spark, sf), KEYS, runs=8)


def q_pac(spark, sf):
    rl = _runs(spark, sf)
    return r6(G.pac(G.consensus_histogram(rl, KEYS, runs=8), rl, KEYS))


QUERIES.update({
    "topic_ids": q_topic_ids, "ctfidf": q_ctfidf, "topic_words": q_topic_words,
    "topic_info": q_topic_info, "topic_freq": q_topic_freq, "doc_assignments": q_doc_assignments,
    "titles_report": q_titles_report, "representative_docs": q_representative_docs,
    "topic_diff": q_topic_diff, "label_prompt": q_label_prompt, "topic_labels": q_topic_labels,
    "label_changes": q_label_changes, "topics_to_show": q_topics_to_show,
    "barchart_data": q_barchart_data, "topic_similarity": q_topic_similarity,
    "heatmap_k": q_heatmap_k,
    "word_df": q_word_df, "pair_df": q_pair_df, "npmi": q_npmi, "umass": q_umass,
    "coherence_summary": q_coherence_summary,
    "size_metrics": q_size_metrics, "silhouette_cosine": q_silhouette_cosine,
    "davies_bouldin": q_davies_bouldin, "calinski_harabasz": q_calinski_harabasz,
    "ari_vi_adjacent": q_ari_vi_adjacent, "consensus_pairs": q_consensus_pairs, "pac": q_pac,
})


# --- vectors (D) and density (E) -------------------------------------------------------
from docsift.functions.vectors import l2norm as _l2norm  # noqa: E402
from docsift.operators import cells as Ce  # noqa: E402
from docsift.operators import density as Dn  # noqa: E402
from docsift.operators import knn as Kn  # noqa: E402
from docsift.operators import vectors as V  # noqa: E402

SWEEP = (5, 10, 20, 30, 50, 75, 100)


def _vecs(spark, sf):
    return bind.vectors(spark, sf).select("doc_id", "vec")


def q_l2_normalise(spark, sf):
    v = V.l2_normalise(_vecs(spark, sf))
    return r6(V.melt(v))


def q_melt_embedding(spark, sf):
    return r6(V.melt(_vecs(spark, sf)))


def q_alignment_report(spark, sf):
    from docsift.operators.corpus import alignment_report
    from docsift.sources.corpus import read_table
    return alignment_report(read_table(spark, sf, "documents"), read_table(spark, sf, "embeddings"))


def q_wide_embedding(spark, sf):
    v = _vecs(spark, sf)
    dim = len(v.select("vec").first()[0])
    back = V.from_wide(V.to_wide(v, dim))
    return r6(V.to_wide(back, dim))


def q_embedding_meta(spark, sf):
    return V.embedding_meta(_vecs(spark, sf), model="given", source="embeddings")


def q_scatter_split(spark, sf):
    v = bind.vectors(spark, sf)
    pts = v.select("doc_id", F.col("vec")[0].cast("double").alias("x"),
                   F.col("vec")[1].cast("double").alias("y"))
    lab = v.select("doc_id", F.when(F.col("cluster") == 9, F.lit(-1)).otherwise(F.col("cluster"))
                   .alias("cluster"))
    return r6(V.scatter_split(pts, lab))


def q_knn_exact(spark, sf):
    return r6(Kn.knn_exact(_vecs(spark, sf), 10, "cosine"))


def q_knn_ivf(spark, sf):
    """Neighbours through cells, with the cells that the k-th distance leaves open searched too: exact."""
    return r6(Ce.knn_ivf(_vecs(spark, sf), 10, "cosine", refine=True))


def q_core_distance(spark, sf):
    knn = Kn.knn_exact(_vecs(spark, sf), 4, "cosine")
    return r6(Dn.core_distance(knn, 5))


def q_mutual_reach(spark, sf):
    knn = cut_lineage(Kn.knn_exact(_vecs(spark, sf), 4, "cosine"))     # read for edges and for core distances
    return r6(Dn.mutual_reach(knn, Dn.core_distance(knn, 5)))


def _reduced(spark, sf, k=5):
    return V.reduce_dims(_vecs(spark, sf), k)


def q_mst_edges(spark, sf):
    """Edges and total weight of the spanning tree (a tree's edges are not unique under equal weights)."""
    tree = Dn.mst(_vecs(spark, sf), 5, "euclidean")
    return r6(tree.agg(F.count(F.lit(1)).alias("n_edges"), F.sum("w").alias("total_weight")))


def q_density_labels(spark, sf):
    labels, _ = Dn.sweep(_reduced(spark, sf), SWEEP)
    return labels


def q_persistence_summary(spark, sf):
    _, clusters = Dn.sweep(_reduced(spark, sf), SWEEP)
    settings = spark.createDataFrame([(m,) for m in SWEEP], "min_cluster_size int")
    return G.persistence_summary(clusters, settings, KEYS)


def q_embed(spark, sf):
    return V.embed(bind.clean_documents(spark, sf), "title_abstract", dim=768)


def q_reduce(spark, sf):
    return V.coords(_reduced(spark, sf, 2))


QUERIES.update({
    "l2_normalise": q_l2_normalise, "melt_embedding": q_melt_embedding,
    "wide_embedding": q_wide_embedding, "alignment_report": q_alignment_report, "embedding_meta": q_embedding_meta,
    "scatter_split": q_scatter_split, "knn_exact": q_knn_exact, "knn_ivf": q_knn_ivf, "core_distance": q_core_distance,
    "mutual_reach": q_mutual_reach, "mst_edges": q_mst_edges, "density_labels": q_density_labels,
    "persistence_summary": q_persistence_summary, "embed": q_embed, "reduce": q_reduce,
})


# --- remaining topic / evaluation operators ----------------------------------------------
from docsift.operators import validity as Va  # noqa: E402


def q_topic_hierarchy(spark, sf):
    _, assign, _, ct, _, _ = _model(spark, sf, False)
    _, groups = T.topic_hierarchy(T.topic_similarity(ct, KEYS), T.heatmap_k(assign, keys=KEYS), KEYS)
    return groups


def q_dbcv(spark, sf):
    lab, vec = _vec(spark, sf)
    return r6(Va.dbcv(lab, vec, metric="cosine"))


def q_dbcv_sweep(spark, sf):
    return r6(Va.dbcv(bind.vector_labels_by_setting(spark, sf), _vec(spark, sf)[1], metric="cosine", keys=KEYS))


def q_separation_sweep(spark, sf):
    """Silhouette, Davies-Bouldin and Calinski-Harabasz of every setting."""
    lab, vec = bind.vector_labels_by_setting(spark, sf), _vec(spark, sf)[1]
    out = G.silhouette_cosine(lab, vec, keys=KEYS)
    for metric in (G.davies_bouldin, G.calinski_harabasz):
        out = out.join(metric(lab, vec, keys=KEYS), KEYS)
    return r6(out)


def q_fuzzy_graph(spark, sf):
    return r6(V.fuzzy_graph(cut_lineage(Kn.knn_exact(_vecs(spark, sf), 15, "cosine"))))


def _doc_vectors(spark, sf, clean):
    """The documents' vectors as a table: a projection reads them several times."""
    return cut_lineage(V.embed(clean, "title_abstract", dim=768))


def q_rerank_words(spark, sf):
    clean, assign, _, ct, _, _ = _model(spark, sf, False)
    return r6(T.rerank_words(ct, _dtf(clean), _doc_vectors(spark, sf, clean), assign, 30, 10, KEYS))


def _doc_coords(spark, sf, clean):
    return V.coords(V.reduce_dims(_doc_vectors(spark, sf, clean), 2))


def q_document_map(spark, sf):
    clean, assign = bind.clean_documents(spark, sf), _assign(spark, sf)
    return r6(T.document_map(assign, clean, _doc_coords(spark, sf, clean), KEYS))


def q_datamap(spark, sf):
    clean, assign = bind.clean_documents(spark, sf), _assign(spark, sf)
    labels = T.numeric_labels(assign, KEYS)
    return r6(T.datamap_data(assign, clean, _doc_coords(spark, sf, clean), labels, 17, KEYS))


def q_preview(spark, sf):
    _, assign, words, _ = _words(spark, sf)
    return T.topic_info(assign, words, KEYS).orderBy(*KEYS, "topic").limit(10)


def q_numeric_labels(spark, sf):
    return T.numeric_labels(_assign(spark, sf), KEYS)


def q_eval_summary(spark, sf):
    """Per-setting summary: sizes, consensus PAC, coherence, separation and DBCV joined on the setting."""
    clean = bind.clean_documents(spark, sf)
    sizes = G.size_metrics(bind.labels_by_setting(clean), KEYS)
    rl = _runs(spark, sf)
    p = G.pac(G.consensus_histogram(rl, KEYS, runs=8), rl, KEYS)
    _, assign, words, toks, _, dv = _coh(spark, sf)
    coh = H.coherence_summary(H.npmi_umass(toks, words, 10, KEYS, dv), assign, KEYS)
    out = sizes.join(p, KEYS, "left").join(coh, KEYS, "left")
    return r6(out.join(q_separation_sweep(spark, sf), KEYS, "left").join(q_dbcv_sweep(spark, sf), KEYS, "left"))


def q_fit_topics(spark, sf):
    """End to end: documents -> vectors -> 5-d projection -> density sweep -> topics."""
    clean = bind.clean_documents(spark, sf)
    vecs = cut_lineage(V.reduce_dims(_doc_vectors(spark, sf, clean), 5))
    labels, _ = Dn.sweep(vecs, SWEEP)
    assign = T.topic_ids(labels, KEYS)
    words = cut_lineage(T.topic_words(T.ctfidf(assign, C.doc_texts(clean), KEYS), 10, KEYS))
    return T.topic_info(assign, words, KEYS)


QUERIES.update({
    "topic_hierarchy": q_topic_hierarchy, "dbcv": q_dbcv,
    "dbcv_sweep": q_dbcv_sweep, "separation_sweep": q_separation_sweep, "fuzzy_graph": q_fuzzy_graph,
    "rerank_words": q_rerank_words, "document_map": q_document_map, "datamap": q_datamap,
    "preview": q_preview, "numeric_labels": q_numeric_labels, "eval_summary": q_eval_summary,
    "fit_topics": q_fit_topics,
})


def q_bootstrap_pac(spark, sf):
    """Bootstrap draws, each projected anew and re-clustered at every setting (runs and settings as keys), then PAC."""
    bl = Dn.bootstrap_labels(_vecs(spark, sf), SWEEP, runs=8, refit_dims=5)
    bl = Dn._ckpt(bl)
    return r6(G.pac(G.consensus_histogram(bl, KEYS, runs=8), bl, KEYS))


QUERIES["bootstrap_pac"] = q_bootstrap_pac
