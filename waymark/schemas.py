"""Explicit schemas and controlled vocabularies of the segment tables."""

from __future__ import annotations

from pyspark.sql import types as T


#: The published tables' columns.
SEGMENTS = T.StructType(
    [
        T.StructField("km_inicio", T.IntegerType()),
        T.StructField("km_fin", T.IntegerType()),
        T.StructField("s_inicio_km", T.DoubleType()),
        T.StructField("s_fin_km", T.DoubleType()),
        T.StructField("longitud_traza_km", T.DoubleType()),
        T.StructField("factor_local", T.DoubleType()),
        T.StructField("metodo_calibracion", T.StringType()),
    ]
)
CONTROL_POINTS = T.StructType(
    [
        T.StructField("progresiva_km", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("confianza", T.StringType()),
        T.StructField("fuente", T.StringType()),
        T.StructField("fecha_relevamiento", T.DateType()),
        T.StructField("observacion", T.StringType()),
    ]
)
REFERENCE_ELEVATIONS = T.StructType(
    [
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("elevacion_m", T.DoubleType()),
        T.StructField("toponimo", T.StringType()),
        T.StructField("fuente", T.StringType()),
        T.StructField("fecha", T.StringType()),
    ]
)
HAZARDS = T.StructType(
    [
        T.StructField("km_inicio", T.IntegerType()),
        T.StructField("km_fin", T.IntegerType()),
        T.StructField("peligro", T.StringType()),
        T.StructField("categoria", T.StringType()),
        T.StructField("estacionalidad", T.StringType()),
        T.StructField("nivel", T.StringType()),
        T.StructField("fuente", T.StringType()),
    ]
)
SPEEDS = T.StructType(
    [
        T.StructField("progresiva_km", T.DoubleType()),
        T.StructField("velocidad_max_kmh", T.IntegerType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("fuente", T.StringType()),
        T.StructField("observacion", T.StringType()),
    ]
)
NEIGHBOURS = T.StructType(
    [
        T.StructField("segment_id", T.StringType()),
        T.StructField("km_inicio", T.IntegerType()),
        T.StructField("km_fin", T.IntegerType()),
        T.StructField("neighbor_segment_id", T.StringType()),
        T.StructField("neighbor_km_inicio", T.IntegerType()),
        T.StructField("neighbor_km_fin", T.IntegerType()),
        T.StructField("distance_order", T.IntegerType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("fuente", T.StringType()),
    ]
)
CELLS = T.StructType(
    [
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)
CUBE = T.StructType(
    [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("variable", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

#: Ordered levels and classes, and the kinds of evidence.
LEVELS = ("medio", "alto_medio", "alto")
CLASSES = ("muy_baja", "baja", "media", "alta", "muy_alta")
CATEGORIES = ("hidrologico", "climatico", "topografico", "geologico", "altitudinal", "operacional", "fauna")
EVIDENCE = ("observed", "derived", "simulated")
DIRECTIONS = ("increase", "decrease", "stable")
CHANGES = ("stable", "minor", "moderate", "major")
