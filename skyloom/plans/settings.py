"""Spark settings that the raster plans are meant to run with."""

#: HotSpot compiles no method above 8,000 bytes of bytecode; a stage that generates a longer one (true
#: colour with its geometry does) runs faster operator by operator than fused and interpreted.
#: Tables bucketed by tile (sources.tiles) are joined and grouped by more columns than they are bucketed by;
#: a task that writes one has one bucket, so it needs no sort to keep few files open.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.maxConcurrentOutputFileWriters": "4",
}
