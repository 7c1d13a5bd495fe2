"""Schemas of all entities."""

from __future__ import annotations

#: Spark DDL by entity.
DDL = {
    "frames": "frame_index int, rgb binary, depth binary, h int, w int, pose array<double>, k array<double>, depth_scale double",
    "points": "owner_id string, pid bigint, x double, y double, z double, r double, g double, b double",
    "floors": "floor_id string, low double, high double",
    "rooms": "room_id string, floor_id string, name string, category string, polygon array<struct<x:double,z:double>>, zero_level double, height double",
    "room_frames": "room_id string, frame_index int, is_keyframe boolean",
    "objects": "room_id string, object_id string, label string, bbox array<array<double>>, feature array<float>, vlm_description string, best_frame int",
    "object_detections": "room_id string, object_id string, frame_index int, x1 double, y1 double, x2 double, y2 double, score double",
    "functional_elements": "room_id string, parent_id string, object_id string, label string",
    "descriptions": "room_id string, frame_index int, caption string, room_type_guess string, description string, scene_layout string, objects string",
    "object_descriptions": "room_id string, frame_pos int, object_pos int, object_id string, name string, confidence double, attributes array<string>, description string, affordances array<string>, state string, location_description string, spatial_relations array<string>",
    "chunks": "pos bigint, id string, doc_type string, floor_id string, room_id string, content string, content_hash string",
    "embeddings": "pos bigint, modality string, vec array<float>",
    "query_plan": "query_id string, target_object string, anchor_objects array<string>, relation_polarity string, relation_degree string, operator string, behavior string, status string",
    "annotations": "ann_id string, utterance string, target_id string, mentions_target_class boolean, uses_object_lang boolean, uses_spatial_lang boolean, uses_color_lang boolean, uses_shape_lang boolean, is_easy boolean, is_view_dep boolean",
    "selections": "query_id string, object_id string, reason string, confidence double, rejected_ids array<string>, guess_id string",
}
