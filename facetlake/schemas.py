"""Schemas (DDL text) of the tables the operators exchange. Key columns are non-null by contract."""

from __future__ import annotations

PHOTOS = "shoot_id INT, seq BIGINT, path STRING, width INT, height INT"
GRIDS = "shoot_id INT, seq BIGINT, grid ARRAY<INT>"
HASHES = "shoot_id INT, seq BIGINT, h BIGINT, h_flip BIGINT"
FRAMES = "clip_id BIGINT, seq BIGINT, score DOUBLE, ok BOOLEAN"

# One row per triangle with its corner positions inline. Coincidence of vertices is
# positional, so topology needs no index join: an edge is a pair of position keys.
TRIANGLES = (
    "mesh_id STRING, fid BIGINT, ax DOUBLE, ay DOUBLE, az DOUBLE, "
    "bx DOUBLE, by DOUBLE, bz DOUBLE, cx DOUBLE, cy DOUBLE, cz DOUBLE"
)
VERTICES = "mesh_id STRING, vid BIGINT, x DOUBLE, y DOUBLE, z DOUBLE"
FACES = "mesh_id STRING, fid BIGINT, v0 BIGINT, v1 BIGINT, v2 BIGINT"
VOXELS = "mesh_id STRING, i BIGINT, j BIGINT, k BIGINT"
STAGES = (
    "job_id BIGINT, seq BIGINT, name STRING, status STRING, detail STRING, seconds DOUBLE"
)
JOB_LOG = "job_id BIGINT, line_no BIGINT, line STRING, ts TIMESTAMP"

# Nested record of one capture session, as written next to its outputs.
SESSION_RECORD = (
    "session_id STRING, label STRING, created_at STRING, job_id STRING, name STRING, "
    "target_faces BIGINT, faces BIGINT, build_faces BIGINT, regime STRING, warnings ARRAY<STRING>"
)

# Nested record of one machine in a compute listing.
INSTANCE_RECORD = (
    "name STRING, zone STRING, machineType STRING, status STRING, creationTimestamp STRING, "
    "sourceMachineImage STRING, "
    "guestAccelerators ARRAY<STRUCT<acceleratorType: STRING, acceleratorCount: INT>>, "
    "scheduling STRUCT<provisioningModel: STRING, preemptible: BOOLEAN, "
    "maxRunDuration: STRUCT<seconds: STRING>>, "
    "metadata STRUCT<items: ARRAY<STRUCT<key: STRING, value: STRING>>>"
)

# Nested record of one photo-intake report.
INTAKE_REPORT = (
    "photos ARRAY<STRUCT<source: STRING, status: STRING, reject_reasons: ARRAY<STRING>>>, "
    "advice ARRAY<STRING>"
)
