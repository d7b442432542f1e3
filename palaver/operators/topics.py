"""Topics: communities of words that stand near each other more often than chance.

Words at most ``reach`` places apart are a pair, so a text makes a number of pairs in proportion to its
length. Pairs of words of the vocabulary whose pointwise mutual information is high enough are the edges of
a graph; labels spread along them until every word has the label with the greatest weight around it.
Weights are whole numbers and ties go to the smaller label, so runs agree.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.operators import word_batches
from palaver.operators.search_index import DOCUMENT, tokens
from palaver.session import shared_folder

REACH = 3
SCALE = 1000  # weights are thousandths
SENT = 4_000_000  # words; a vocabulary of no more is sent to every task, and pairs are counted by its numbers


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut(messages: DataFrame) -> DataFrame:
    """``channel, timestamp, words``, stored: the functions here take it in place of the messages, whose words are then cut out once."""
    words = messages.select(*DOCUMENT, tokens(F.col("text")).alias("words"))
    return _store(words, f"{shared_folder(messages.sparkSession, 'topic-words')}/words")


def _words(messages: DataFrame) -> DataFrame:
    """The messages that have a text, with their ``words``."""
    if "words" in messages.columns:
        return messages.filter("words IS NOT NULL")
    return messages.filter("text IS NOT NULL").withColumn("words", tokens(F.col("text")))


def vocabulary(messages: DataFrame, least: int = 3, share: float = 0.2) -> DataFrame:
    """``term, tf, df, score`` of the words in ``least`` messages or more, and in no more than ``share`` of them all.

    ``score`` is TF-IDF over the whole table. Single characters are no words here.
    """
    # filters are on the text: one on the words would cut them out of it a second time
    words = _words(messages).select(F.filter("words", lambda w: F.length(w) > 1).alias("words"))
    # a batch of messages is counted in its task; only its different words are exchanged
    listed = words.mapInArrow(word_batches.by_run(word_batches.term_counts), "term string, tf bigint, df bigint")
    counted = listed.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    n = messages.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    kept = counted.filter((F.col("df") >= least) & (F.col("df") <= share * n))
    return kept.withColumn("score", F.round(F.col("tf") * F.ln(n / F.col("df")), 6))


def neighbours(messages: DataFrame, reach: int = REACH) -> DataFrame:
    """``a, b, n`` with ``a < b``: how often two different words stand at most ``reach`` places apart."""
    words = _words(messages).select("words")

    pairs = words.mapInArrow(word_batches.by_run(word_batches.pair_counts, reach=reach), "a string, b string, n bigint")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def graph(pairs: DataFrame, terms: DataFrame, least: int = 3, information: float = 1.0) -> DataFrame:
    """``a, b, weight``: pairs of vocabulary words met ``least`` times or more whose mutual information reaches ``information``."""
    known = terms.select("term")
    inside = pairs.join(known.withColumnRenamed("term", "a"), "a", "left_semi").join(known.withColumnRenamed("term", "b"), "b", "left_semi")
    return _weighed(inside, least, information)


def _weighed(inside: DataFrame, least: int, information: float) -> DataFrame:
    """The edges among pairs of vocabulary words, named or numbered in the order of their names."""
    ends = inside.select(F.explode(F.array("a", "b")).alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n"))
    total = inside.agg(F.sum("n").alias("total")).select("total").scalar()
    met = inside.filter(F.col("n") >= least)
    joined = met.join(ends.select(F.col("term").alias("a"), F.col("n").alias("n_a")), "a").join(ends.select(F.col("term").alias("b"), F.col("n").alias("n_b")), "b")
    # a word is an end of a pair in two ways, hence 2: both ends are drawn from the same words
    mutual = F.ln(2 * F.col("n") * total / (F.col("n_a") * F.col("n_b")))
    weighed = joined.select("a", "b", F.floor(SCALE * mutual).cast("bigint").alias("weight"))
    return weighed.filter(F.col("weight") >= int(SCALE * information))


def spread(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """``term, topic``: the label of every word of the graph after ``rounds``, or as soon as no label changes.

    A word starts with itself as label and takes the one of greatest weight among its neighbours, its own counting with
    its heaviest edge, ties to the smaller label. Each round is a table in the shared folder; sums by word and label are begun
    before the exchange and the adaptive join splits a word of very many edges.
    """
    spark, folder = edges.sparkSession, shared_folder(edges.sparkSession, "topics")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    both = _store(both, f"{folder}/edges")
    heaviest = both.groupBy("a").agg(F.max("weight").alias("weight"))
    loops = heaviest.select("a", F.col("a").alias("b"), "weight")
    around = _store(both.unionByName(loops), f"{folder}/around")
    labels = _store(heaviest.select(F.col("a").alias("term"), F.col("a").alias("topic")), f"{folder}/round=0")
    for i in range(1, rounds + 1):
        votes = around.join(labels, F.col("b") == F.col("term")).groupBy("a", "topic").agg(F.sum("weight").alias("weight"))
        best = votes.groupBy(F.col("a").alias("term")).agg(F.min(F.struct((-F.col("weight")).alias("w"), "topic"))["topic"].alias("topic"))
        after = _store(best, f"{folder}/round={i}")
        changed = after.alias("x").join(labels.alias("y"), "term").filter("x.topic <> y.topic")
        labels, settled = after, changed.isEmpty()
        if settled:
            break
    return labels


def named(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """``topic, term, size, score``: members of every topic, named by the one of highest TF-IDF, ties by word."""
    scored = labels.withColumnRenamed("topic", "_label").join(terms.select("term", "score"), "term")
    best = F.min(F.struct((-F.col("score")).alias("s"), "term"))["term"]
    heads = scored.groupBy("_label").agg(best.alias("topic"), F.count(F.lit(1)).alias("size"))
    return scored.join(heads, "_label").select("topic", "term", "size", "score")


def leading(found: DataFrame, k: int = 10) -> DataFrame:
    """``topic, rank, term, size, score``: the ``k`` best members of every topic."""
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "term"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("topic", "rank", "term", "size", "score")


def _numbers(words: DataFrame) -> pa.Array | None:
    """The words in their order, a word's place being its number; none if they are too many to be sent to every task."""
    if words.limit(SENT + 1).count() > SENT:
        return None
    return _plain(words.select("term").orderBy("term").toArrow()["term"])


def _known_neighbours(messages: DataFrame, reach: int, words: pa.Array) -> DataFrame:
    """``a, b, n`` as :func:`neighbours`, of vocabulary words alone and by their numbers: a pair is exchanged as one number."""
    sent = messages.sparkSession.sparkContext.broadcast(words)
    pairs = _words(messages).select("words").mapInArrow(word_batches.by_run(word_batches.known_pairs, reach=reach, vocabulary=sent), "pair bigint, n bigint")
    counted, size = pairs.groupBy("pair").agg(F.sum("n").alias("n")), F.lit(max(len(words), 1)).cast("bigint")
    return counted.select(F.call_function("div", "pair", size).alias("a"), (F.col("pair") % size).alias("b"), "n")


def topics(messages: DataFrame, least: int = 3, share: float = 0.2, reach: int = REACH, information: float = 1.0, rounds: int = 20) -> DataFrame:
    """``topic, term, size, score`` of every word that has a topic. Null and empty texts have no words."""
    folder = shared_folder(messages.sparkSession, "topic-terms")
    terms = _store(vocabulary(messages, least, share), f"{folder}/terms")
    words = _numbers(terms)
    if words is None:
        edges = graph(_store(neighbours(messages, reach), f"{folder}/pairs"), terms, least, information)
        return named(spread(edges, rounds), terms)
    # numbers follow the order of the words, so ties between them are those between the words
    listed = messages.sparkSession.createDataFrame(pa.table({"number": pa.array(range(len(words)), pa.int64()), "word": words}))
    listed = _store(listed, f"{folder}/numbers")
    edges = _weighed(_store(_known_neighbours(messages, reach, words), f"{folder}/pairs"), least, information)
    found = named(spread(edges, rounds), terms.join(listed, F.col("term") == F.col("word")).select(F.col("number").alias("term"), "score"))
    heads = listed.select(F.col("number").alias("topic"), F.col("word").alias("_topic"))
    members = listed.select(F.col("number").alias("term"), F.col("word").alias("_term"))
    return found.join(heads, "topic").join(members, "term").select(F.col("_topic").alias("topic"), F.col("_term").alias("term"), "size", "score")


def message_topics(messages: DataFrame, found: DataFrame) -> DataFrame:
    """``channel, timestamp, topic, hits``: the topic with most words in a message, ties by name; messages without any have none."""
    words = _words(messages).select(*DOCUMENT, "words")
    found = _store(found.select("term", "topic"), f"{shared_folder(messages.sparkSession, 'topics')}/found")
    hits = _topic_hits(words, found)
    per_topic = hits.groupBy(*DOCUMENT, "topic").agg(F.sum("n").alias("hits"))
    best = per_topic.groupBy(*DOCUMENT).agg(F.min(F.struct((-F.col("hits")).alias("h"), "topic")).alias("best"))
    return best.select(*DOCUMENT, "best.topic", (-F.col("best.h")).alias("hits"))


def _topic_hits(words: DataFrame, found: DataFrame) -> DataFrame:
    """``channel, timestamp, topic, n``: how many words of a message are of a topic, counted in its row where the topics can be sent to every task."""
    known = None if found.limit(SENT + 1).count() > SENT else found.filter("term IS NOT NULL").toArrow().combine_chunks()
    if known is None or known["topic"].null_count or len(known["term"].unique()) < len(known):
        counted = words.mapInArrow(word_batches.by_run(word_batches.row_counts), "channel string, timestamp string, term string, n bigint")
        return counted.join(found, "term")
    names = known["topic"].unique()
    place = pc.index_in(known["topic"], value_set=names).to_numpy().astype("int64")
    send = words.sparkSession.sparkContext.broadcast
    work = word_batches.by_run(word_batches.topic_counts, vocabulary=send(_plain(known["term"])), place=send(place), names=send(_plain(names)))
    return words.mapInArrow(work, "channel string, timestamp string, topic string, n bigint")


def _plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of plain strings, as the words of a batch are."""
    return pa.concat_arrays(column.chunks or [pa.array([], pa.string())]).cast(pa.string()) if isinstance(column, pa.ChunkedArray) else column.cast(pa.string())
