"""Schemas of the raw catalogue document and of the knowledge tables."""

from __future__ import annotations

from pyspark.sql import types as T

MEASURE_IN = "struct<value:double,value_secondary:double,unit:string,unit_secondary:string,d:double,raw:string>"
MEASURE = "struct<value:double,secondaryValue:double,unit:string,secondaryUnit:string,d:double,raw:string>"
SPEC = "struct<value:double,unit:string,secondaryValue:double,secondaryUnit:string,note:string>"

_SHARED = f"series:string,table_title:string,model_group:string,search_aliases:string,repeatability:{MEASURE_IN},linearity:{MEASURE_IN},ocl:{MEASURE_IN}"

CURRENT_IN = (
    f"struct<{_SHARED},tolerance:{MEASURE_IN},capacity_primary:double,capacity_primary_unit:string,capacity_secondary:double,capacity_secondary_unit:string,capacity_annotation:string,"
    "readability:double,readability_unit:string,readability_secondary:double,readability_secondary_unit:string,readability_annotation:string,"
    "astm_class:string,oiml_class:string,source_manual:string,source_pdf_page:int>"
)
LEGACY_IN = f"struct<{_SHARED},source_manual:string,source_pdf_page:int>"
TEMPERATURE = (
    "struct<model_group:string,temperature_tolerance_c:double,display_range_min_c:double,display_range_max_c:double,cal_setpoints_c:string,source_pdf_page:int,"
    "heater_technology:string,temperature_readability_c:double,adjustment_mass_value:double,adjustment_mass_unit:string>"
)
GUIDANCE = "struct<section:int,source_pdf_page:int>"

#: Elements of the tables that pass through are kept as they are, whatever they hold; those of two
#: tables are also read, by these members.
PASSED = "array<variant>"
READ_MEMBERS = {"temperature_specs": TEMPERATURE, "guidance": GUIDANCE}
DOCUMENT = (
    f"document_date string, current array<{CURRENT_IN}>, legacy array<{LEGACY_IN}>, temperature_specs {PASSED}, guidance {PASSED}, "
    f"weight_class_crossmap {PASSED}, series_class_recommendations {PASSED}, mass_tolerances {PASSED}"
)

_RECORD = "id:string,lifecycle:string,series:string,tableTitle:string,modelGroup:string,aliases:array<string>"
_SOURCE = "source:struct<manual:string,page:int>"
CURRENT_OUT = (
    f"struct<{_RECORD},capacity:{SPEC},readability:{SPEC},repeatability:{MEASURE},linearity:{MEASURE},ocl:{MEASURE},tolerance:{MEASURE},"
    f"calibration:struct<astm:string,oiml:string>,{_SOURCE},qa:struct<status:string,messages:array<string>>>"
)
LEGACY_OUT = f"struct<{_RECORD},repeatability:{MEASURE},linearity:{MEASURE},ocl:{MEASURE},{_SOURCE}>"
META = "struct<title:string,documentDate:string,currentRecords:bigint,legacyRecords:bigint,temperatureRecords:bigint,knownQaItems:int>"

#: The prepared document.
OUTPUT = f"meta {META}, current array<{CURRENT_OUT}>, legacy array<{LEGACY_OUT}>, temperatureSpecs {PASSED}, classCrossMap {PASSED}, seriesClassRecommendations {PASSED}, massTolerances {PASSED}, guidance {PASSED}"


def fields(of: str) -> list[T.StructField]:
    """The members of a struct type in DDL."""
    return list(T.StructType.fromDDL(f"e {of}")["e"].dataType)
