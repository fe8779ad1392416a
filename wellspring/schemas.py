"""Column names and schemas of the layers."""

from __future__ import annotations

from pyspark.sql import types as T

STATION = "station_id"
TS = "timestamp"
EVENT = "event_id"

# Names in the bronze readings file and in the engine.
READING_NAMES = {
    "DATA/HORA": "timestamp",
    "VAZÃO ENTRADA (L/S)": "input_flow_rate",
    "NÍVEL RESERVATÓRIO (%)": "reservoir_level_percentage",
    "PRESSÃO (mca)": "pressure",
    "GMB 1 (10 OFF/ 90 ON)": "pump_1",
    "GMB 2(10 OFF/ 90 ON)": "pump_2",
}

# Names in the bronze weather file and in the engine.
WEATHER_NAMES = {
    "PRECIPITAÇÃO TOTAL, HORÁRIO (mm)": "total_precip_mm",
    "PRESSAO ATMOSFERICA AO NIVEL DA ESTACAO, HORARIA (mB)": "station_pressure_mb",
    "PRESSÃO ATMOSFERICA MAX.NA HORA ANT. (AUT) (mB)": "max_pressure_last_hour_mb",
    "PRESSÃO ATMOSFERICA MIN. NA HORA ANT. (AUT) (mB)": "min_pressure_last_hour_mb",
    "RADIACAO GLOBAL (Kj/m²)": "global_radiation_kj_m2",
    "TEMPERATURA DO AR - BULBO SECO, HORARIA (°C)": "air_temp_c",
    "TEMPERATURA DO PONTO DE ORVALHO (°C)": "dew_point_temp_c",
    "TEMPERATURA MÁXIMA NA HORA ANT. (AUT) (°C)": "max_temp_last_hour_c",
    "TEMPERATURA MÍNIMA NA HORA ANT. (AUT) (°C)": "min_temp_last_hour_c",
    "TEMPERATURA ORVALHO MAX. NA HORA ANT. (AUT) (°C)": "max_dew_point_last_hour_c",
    "TEMPERATURA ORVALHO MIN. NA HORA ANT. (AUT) (°C)": "min_dew_point_last_hour_c",
    "UMIDADE REL. MAX. NA HORA ANT. (AUT) (%)": "max_humidity_last_hour_percentage",
    "UMIDADE REL. MIN. NA HORA ANT. (AUT) (%)": "min_humidity_last_hour_percentage",
    "UMIDADE RELATIVA DO AR, HORARIA (%)": "relative_humidity_percentage",
    "VENTO, DIREÇÃO HORARIA (gr) (° (gr))": "wind_direction_deg",
    "VENTO, RAJADA MAXIMA (m/s)": "max_wind_gust_m_s",
    "VENTO, VELOCIDADE HORARIA (m/s)": "wind_speed_m_s",
}
WEATHER_DATE_TEXT = "Data"
WEATHER_HOUR_TEXT = "Hora UTC"
# Join keys and kept columns of the weather.
WEATHER_KEYS = ["hour", "day", "month", "year"]
WEATHER_KEPT = [
    "relative_humidity_percentage",
    "max_temp_last_hour_c",
    "min_temp_last_hour_c",
    "air_temp_c",
    "total_precip_mm",
]
# The weather columns that go on into the hourly table.
WEATHER = ["air_temp_c", "total_precip_mm", "relative_humidity_percentage"]

MEASURES = ["input_flow_rate", "reservoir_level_percentage", "output_flow_rate", "pressure"]
MEASURE_STATS = [f"{m}_{s}" for m in MEASURES for s in ("first", "last", "mean")]
PUMP_SECONDS = ["pump_1_duration_sum", "pump_2_duration_sum"]
HOUR_CHANGES = [
    "input_flow_rate_diff",
    "output_flow_rate_diff",
    "reservoir_level_change",
    "pressure_change",
]
PUMP_FLAGS = ["pump_1_active", "pump_2_active"]
FLOW_CHANGE = "change_from_last_hour_output_flow_rate_mean"
DATE_PARTS = ["year", "month", "day", "day_of_week", "week_of_year", "hour"]

COMBINED_COLUMNS = [
    STATION, EVENT, TS, "minute", "hour", "day_of_week", "week_of_year", "year",
    "input_flow_rate", "reservoir_level_percentage", "pressure", "output_flow_rate",
    "pump_1", "pump_2", *WEATHER, "time_diff", "pump_1_duration", "pump_2_duration",
]

SILVER_COLUMNS = [
    STATION, TS, *DATE_PARTS, *MEASURE_STATS, *PUMP_SECONDS, *WEATHER, *HOUR_CHANGES,
    *PUMP_FLAGS, FLOW_CHANGE, "inputed_row",
]

STATE_COLUMNS = [
    TS, "hour", "day_of_week", "week_of_year", *MEASURE_STATS, *PUMP_SECONDS, *HOUR_CHANGES,
    *PUMP_FLAGS,
]


def _schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, _type(c)) for c in columns])


def _type(column: str) -> T.DataType:
    if column == TS:
        return T.TimestampNTZType()
    if column == EVENT:
        return T.LongType()
    if column == STATION or column in (*DATE_PARTS, "minute", "pump_1", "pump_2"):
        return T.IntegerType()
    if column in (*PUMP_FLAGS, "inputed_row"):
        return T.BooleanType()
    return T.DoubleType()


READINGS = _schema([STATION, EVENT, *READING_NAMES.values()])
COMBINED = _schema(COMBINED_COLUMNS)
SILVER = _schema(SILVER_COLUMNS)
