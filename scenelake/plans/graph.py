"""The scene graph: navigation, grounding, frame search and questions, over sets of queries.

Queries are rows (query_id, text). Each method is one plan over all of them;
providers are called in Arrow batches at two points, the analysis of a query
and the selection at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import objects as O
from ..operators import relations as R
from ..operators import retrieval as S
from ..operators import table_functions
from ..providers import calls
from ..sources import work


def neighbours(objects: DataFrame) -> DataFrame:
    """room_id, object_id, nearby: sorted labels of the other objects of a room, for rooms of two objects or more.

    A room's labels are counted before they meet its objects; a label is left
    out where only the object itself has it. So no pair of objects is formed.
    """
    o = objects.select("room_id", "object_id", "label")
    each = o.groupBy("room_id", "label").agg(F.count("*").alias("n"))
    rooms = each.groupBy("room_id").agg(F.sum("n").alias("_all"), F.collect_list(F.struct("label", "n")).alias("_labels")).filter("_all > 1")
    others = F.filter("_labels", lambda x: x.label.isNotNull() & (~x.label.eqNullSafe(F.col("label")) | (x.n > 1)))
    return o.join(rooms, "room_id").select("room_id", "object_id", F.array_sort(F.transform(others, lambda x: x.label)).alias("nearby"))


class SceneGraph:
    """floors, rooms, keyframes (room_id, room_pos, frame_index, object_ids, path, labeled_path, description), objects
    (room_id, object_id, label, x, y, z, h), chunks (pos, id, doc_type, floor_id, room_id, content, content_hash) and
    vectors (pos, modality, vec)."""

    def __init__(self, floors: DataFrame, rooms: DataFrame, keyframes: DataFrame, objects: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, provider: str = "offline"):
        self.floors, self.rooms, self.keyframes, self.objects, self.chunks, self.provider = floors, rooms, keyframes, objects, chunks, provider
        self._vectors = vectors

    @property
    def vectors(self) -> DataFrame:
        """Embedded chunks, made and written when first asked for, as every search reads them."""
        if self._vectors is None:
            self._vectors = work.written(embedded(self.chunks, self.provider), "vectors")
        return self._vectors

    def views(self) -> None:
        """Every entity as a temporary view, and the kernels as table functions, for SQL."""
        table_functions.register(self.floors.sparkSession)
        for name in ("floors", "rooms", "keyframes", "objects", "chunks"):
            getattr(self, name).createOrReplaceTempView(name)

    def objects_in(self) -> DataFrame:
        """floor_id, room_id, object_id, label: the containment of all objects."""
        return self.floors.select("floor_id").join(self.rooms.select("floor_id", "room_id"), "floor_id").join(self.objects.select("room_id", "object_id", "label"), "room_id")

    def neighbours(self) -> DataFrame:
        """room_id, object_id, nearby: labels of a room's other objects."""
        return neighbours(self.objects)

    def object_keyframes(self, object_frames: DataFrame) -> DataFrame:
        return O.keyframes_of(object_frames, self.keyframes)

    def search(self, queries: DataFrame, top_k: int = 5, doc_types: tuple[str, ...] | None = None, expand: int = 10, modality: str = "both") -> DataFrame:
        """query_id, modality, pos, id, doc_type, content, score, rank. Visual lists lack chunks without images."""
        if modality not in ("text", "visual", "both"):
            raise ValueError("modality is text, visual or both")
        asked = work.written(queries.select("query_id", calls.embedded(F.col("text"), self.provider).alias("qvec")), "asked")
        kinds = [m for m in ("text", "visual") if modality in (m, "both")]
        rows = self.vectors.join(self.chunks.select("pos", "doc_type"), "pos")
        each = [S.search(rows.filter(F.col("modality") == m).drop("modality"), asked, top_k, doc_types, expand, exact_filter=m == "visual").withColumn("modality", F.lit(m)) for m in kinds]
        found = each[0] if len(each) == 1 else each[0].unionByName(each[1])
        return found.join(self.chunks.select("pos", "id", "room_id", "floor_id", "content"), "pos")

    def search_frames(self, queries: DataFrame, top_k: int = 10, modality: str = "both") -> DataFrame:
        """Ranked frames of each query, with the best score over modalities and a short description."""
        found = self.search(queries, 2 * top_k, ("frame",), modality=modality)
        ranked = S.rank_first_seen(found.select("query_id", "modality", "pos", "score"), top_k)
        text = self.chunks.select("pos", "id", "room_id", F.substring("content", 1, 300).alias("description"))
        return ranked.join(text, "pos").select("query_id", "rank", "id", "room_id", "score", "description")

    def analyzed(self, queries: DataFrame) -> DataFrame:
        """With plan; where the analysis fails, the text is the target."""
        out = calls.called(queries.select("query_id", "text"), "analyze", ["text"], "plan", calls.PLAN, self.provider)
        return out.withColumn("target", F.coalesce(F.when(F.col("plan.target_object") != "", F.col("plan.target_object")), "text"))

    def contexts(self, queries: DataFrame, top_k_objects: int = 10, top_k_frames: int = 4, relations: str = "named") -> DataFrame:
        """query_id, text, candidates (ids, best first), context: what a selection sees."""
        plans = work.written(self.analyzed(queries), "plans")  # five branches read it; each query is analysed once
        targets = self.search(plans.select("query_id", F.col("target").alias("text")), top_k_objects, ("object",))
        targets = S.ranked(S.fused_mean(targets.select("query_id", "modality", "pos", "score")).withColumnRenamed("fused", "score"), ["query_id"], [F.desc(F.round("score", 9)), F.asc("pos")], top_k_objects)
        asked = plans.filter(F.size("plan.anchor_objects") > 0).select("query_id", F.array_join("plan.anchor_objects", " ").alias("text"))
        anchors = self.search(asked, top_k_objects, ("object",), modality="text")
        named = self.chunks.filter("doc_type = 'object'").select("pos", "room_id", F.col("id").alias("object_id"), "content").join(self.objects.select("room_id", "object_id", "label", "x", "y", "z", "h"), ["room_id", "object_id"])
        role = lambda df, name: df.select("query_id", "pos", "score").join(named, "pos").withColumn("role", F.lit(name))
        pairs = R.pairs(role(targets, "target").unionByName(role(anchors, "anchor")), 3 if relations == "named" else 5)
        pairs = R.predicates(pairs) if relations == "named" else R.signed(pairs)
        line = F.concat("t_object_id", F.lit(": "), "text", F.lit(" "), "a_object_id")
        said = pairs.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_r", "a_r", line.alias("line")))), lambda x: x.line).alias("relations"))
        listed = targets.join(named, "pos").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "object_id", F.concat("object_id", F.lit(" ("), "label", F.lit("): "), "content").alias("line")))).alias("found"))
        frames = self.search_frames(queries, top_k_frames).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat("id", F.lit(": "), "description").alias("line")))), lambda x: x.line).alias("frames"))
        out = plans.join(listed, "query_id", "left").join(said, "query_id", "left").join(frames, "query_id", "left")
        none = F.array().cast("array<string>")
        lines = lambda c: R.numbered(F.coalesce(c, none))
        related = F.when(F.col("plan.relation_polarity") != "", lines(F.col("relations")))
        found = F.transform("found", lambda x: x.line)
        context = R.context(("Objects", lines(found)), ("Frames", lines(F.col("frames"))), ("Relations", related))
        return out.select("query_id", "text", F.coalesce(F.transform("found", lambda x: x.object_id), none).alias("candidates"), context.alias("context"))

    def ground(self, queries: DataFrame, top_k_objects: int = 10, top_k_frames: int = 4) -> DataFrame:
        """query_id, object_id, room_id, label, reason, confidence, error: the object that each query means.

        An id that is no candidate doesn't count; where the selection fails the
        best candidate stands, and without candidates none.
        """
        out = calls.called(self.contexts(queries, top_k_objects, top_k_frames), "select", ["text", "context", "candidates"], "selection", calls.SELECTION, self.provider)
        ok = lambda c: F.when(F.array_contains("candidates", c), c)
        best = F.get("candidates", F.lit(0))
        chosen = F.coalesce(ok(F.col("selection.object_id")), ok(F.col("selection.guess_id")), F.when(F.col("selection_error").isNotNull(), best))
        out = out.select("query_id", chosen.alias("object_id"), F.when(F.size("candidates") == 0, "No candidates found").otherwise(F.col("selection.reason")).alias("reason"), F.col("selection.confidence").alias("confidence"), F.col("selection_error").alias("error"))
        first = C.first_wins(self.objects.select("object_id", "room_id", "label"), ["object_id"], ["room_id"])
        return out.join(first, "object_id", "left").select("query_id", "object_id", "room_id", "label", "reason", "confidence", "error")

    def answer_question(self, queries: DataFrame, top_k_objects: int = 10, top_k_frames: int = 4) -> DataFrame:
        """query_id, answer, reasoning, object_ids (candidates only); a failure is the answer's text."""
        out = calls.called(self.contexts(queries, top_k_objects, top_k_frames), "answer", ["text", "context", "candidates"], "got", calls.ANSWER, self.provider)
        named = F.filter("candidates", lambda i: F.contains(F.lower(F.coalesce("got.answer", F.lit(""))), F.lower(i)))
        ids = F.array_intersect(F.coalesce("got.object_ids", F.array().cast("array<string>")), "candidates")
        return out.select("query_id", F.coalesce("got.answer", F.concat(F.lit("Error: "), "got_error")).alias("answer"), "got.reasoning", F.when(F.size(ids) > 0, ids).otherwise(F.slice(named, 1, 1)).alias("object_ids"))

    def locate(self, queries: DataFrame, **limits) -> DataFrame:
        """Floor, room and object of 'the X in Y in floor N' queries, by words and scores."""
        from ..functions.text import location_query

        parsed = queries.select("query_id", location_query(F.col("text")).alias("q")).select("query_id", "q.*")
        part = lambda c: parsed.select("query_id", F.lit(c).alias("kind"), calls.embedded(F.coalesce(F.col(c), F.lit("")), self.provider).alias("qvec"))
        asked = work.written(part("floor").unionByName(part("room")).unionByName(part("object")), "located")
        return S.locate(self.chunks.withColumn("name", F.col("id")), self.vectors, asked, parsed, **limits)



def embedded(chunks: DataFrame, provider: str = "offline", cached: DataFrame | None = None, model: str = "offline") -> DataFrame:
    """pos, modality text, vec of all chunks; those whose content a cache (content_hash, model, vec) holds are not embedded again."""
    from ..functions.text import embedding_input

    if cached is None:
        return chunks.select("pos", F.lit("text").alias("modality"), calls.embedded(embedding_input(F.col("content")), provider).alias("vec"))
    known = chunks.join(cached.filter(F.col("model") == model).select("content_hash", "vec").dropDuplicates(["content_hash"]), "content_hash")
    return embedded(C.cache_misses(chunks, cached, model), provider).unionByName(known.select("pos", F.lit("text").alias("modality"), "vec"))
