"""Table schemas, column vocabulary, rule limits and seed rows.

Everything under "fixed values" must equal the behaviour being reproduced;
it is stated once, here, in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# fixed values: column vocabulary (canonical English name -> accepted aliases,
# first present alias wins; the Chinese names are the original headers)
# ---------------------------------------------------------------------------
ALIASES = {
    "current": ["电流", "current", "Current", "I", "i"],
    "voltage": ["电压", "voltage", "Voltage", "V", "v"],
    "power": ["功率", "power", "Power", "P", "p"],
    "timestamp": ["时间戳", "timestamp"],
    "sequence_number": ["序号", "sequence_number"],
    "device_address": ["设备地址", "device_address"],
    "device_type": ["设备类型", "device_type"],
    "temperature": ["温度", "temperature"],
    "humidity": ["湿度", "humidity"],
}
REQUIRED = ["current", "voltage", "power"]
HEADER_MARKER = "序号"          # marks the real header line of a raw file
ANOMALY_FLAG = "is_anomaly"     # originally 异常

# ---------------------------------------------------------------------------
# fixed values: validation messages of the original report, in report order
# ({cols} = missing column names joined by ', ', {col} = the original column name)
# ---------------------------------------------------------------------------
MSG_MISSING = "缺少必需列: {cols}"
MSG_NOT_NUMERIC = "列 '{col}' 包含非数值数据"
MSG_CURRENT_NEGATIVE = "电流值不能为负数"
MSG_CURRENT_ABOVE_MAX = "电流值超出合理范围 (>1000A)"
MSG_VOLTAGE_NEGATIVE = "电压值不能为负数"
MSG_VOLTAGE_ABOVE_MAX = "电压值超出合理范围 (>10000V)"
MSG_POWER_MISMATCH = "功率值与电流电压计算值偏差过大"
ORIGINAL_NAMES = {"current": "电流", "voltage": "电压", "power": "功率"}

# ---------------------------------------------------------------------------
# fixed values: validation limits and defaults
# ---------------------------------------------------------------------------
CURRENT_MIN, CURRENT_MAX = 0.0, 1000.0
VOLTAGE_MIN, VOLTAGE_MAX = 0.0, 10000.0
POWER_TOLERANCE = 0.05
ENERGY_FACTOR = 0.001               # sum(P) * 0.001, labelled kWh originally
IQR_FENCE = 1.5
ZSCORE_LIMIT = 3.0
DEFAULT_DEVICE_ADDRESS = 1
DEFAULT_DEVICE_TYPE = "未知"
SYNTH_DEVICE_TYPE = "测试设备"
UNKNOWN_DEVICE_LABEL = "未知设备"
ALLOWED_EXTENSIONS = ["xlsx", "xls", "csv", "json"]
MAX_FILE_BYTES = 50 * 1024 * 1024
READINGS_PAGE = 1000
EXPERIMENTS_PAGE = 100
PREVIEW_ROWS = 100

# ---------------------------------------------------------------------------
# fixed values: CHECK constraints (column -> allowed values), NOT NULL,
# VARCHAR limits, unique keys
# ---------------------------------------------------------------------------
DEVICE_STATUS = ["normal", "maintenance", "retired"]
EXPERIMENT_TYPES = ["dielectric", "leakage", "normal", "abnormal", "simulation"]
EXPERIMENT_STATUS = ["running", "completed", "cancelled"]
EXPERIMENT_RESULTS = ["pass", "fail", "pending"]
USER_ROLES = ["admin", "engineer", "viewer"]
WRITER_ROLES = ["engineer", "admin"]

CHECKS = {
    "devices": {"status": DEVICE_STATUS},
    "experiments": {"experiment_type": EXPERIMENT_TYPES, "status": EXPERIMENT_STATUS,
                    "result": EXPERIMENT_RESULTS},
    "user_profiles": {"role": USER_ROLES},
}
NOT_NULL = {
    "devices": ["device_serial", "device_model"],
    "experiments": ["experiment_name", "experiment_type"],
    "test_standards": ["standard_code", "standard_name", "test_type"],
    "files": ["file_name"],
    "operation_logs": ["operation_type"],
}
VARCHAR_LIMITS = {
    "devices": {"device_serial": 50, "device_model": 50, "manufacturer": 100, "status": 20},
    "experiments": {"experiment_name": 100, "experiment_type": 50, "status": 20, "result": 20},
    "experiment_data": {"device_type": 50},
    "test_standards": {"standard_code": 50, "standard_name": 200, "test_type": 50},
    "files": {"file_name": 200, "file_path": 500, "file_type": 50},
    "user_profiles": {"full_name": 100, "role": 20, "department": 100, "phone": 20},
    "operation_logs": {"operation_type": 50, "ip_address": 45},
}
UNIQUE_KEYS = {"devices": ["device_serial"], "test_standards": ["standard_code"]}
# columns that stand for a row when its id is not given
NATURAL_KEYS = {
    "devices": ["device_serial"],
    "experiments": ["experiment_name", "device_id", "start_time"],
    "experiment_data": ["experiment_id", "sequence_number"],
    "test_standards": ["standard_code"],
    "files": ["file_path", "file_name"],
    "operation_logs": ["user_id", "operation_type", "operation_detail", "created_at"],
}
DEFAULTS = {
    "devices": {"status": "normal"},
    "experiments": {"status": "running"},
    "user_profiles": {"role": "viewer"},
}

# ---------------------------------------------------------------------------
# fixed values: the four seed test standards (code, name, type, parameters,
# pass criteria)
# ---------------------------------------------------------------------------
SEED_STANDARDS = [
    ("IEC-60947-3-DW", "耐压试验 - IEC 60947-3", "dielectric",
     '{"test_voltage": "1000V DC + 2×额定电压", "test_duration": 60, "leakage_limit": 5}',
     '{"max_leakage_current": 5, "breakdown": false}'),
    ("IEC-62109-2-LC", "泄漏电流试验 - IEC 62109-2", "leakage",
     '{"test_voltage": "1.1×额定电压", "temperatures": [25, 40, 60], "humidity": [60, 93]}',
     '{"max_leakage_25C": 3.5, "max_leakage_60C": 5.0}'),
    ("UL-1741-NC", "正常工况试验 - UL 1741", "normal",
     '{"shutdown_time": 30, "communication_test": true, "remote_control": true}',
     '{"max_shutdown_time": 30, "function_test": "pass"}'),
    ("GB-37408-AC", "异常工况试验 - GB/T 37408", "abnormal",
     '{"overload_levels": [1.1, 1.5, 2.0], "short_circuit": true, "temperature_range": [-40, 85]}',
     '{"protection_triggered": true, "no_damage": true}'),
]

# ---------------------------------------------------------------------------
# fixed values: shape of generated readings (share of the nominal value, Hz)
# ---------------------------------------------------------------------------
SYNTH_POINTS_SECONDS = 300
SYNTH_VOLTAGE_WAVE = (0.1, 0.1)
SYNTH_CURRENT_WAVE = (0.5, 0.05)

# ---------------------------------------------------------------------------
# StructTypes of the stored tables
# ---------------------------------------------------------------------------
S, D, I, L, TS, DT = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.TimestampType(), T.DateType()


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


DEVICES = _st(("id", S), ("device_serial", S), ("device_model", S), ("manufacturer", S),
              ("rated_voltage", D), ("rated_current", D), ("rated_power", D),
              ("manufacture_date", DT), ("calibration_date", DT), ("next_calibration", DT),
              ("status", S), ("created_at", TS), ("updated_at", TS))
EXPERIMENTS = _st(("id", S), ("experiment_name", S), ("experiment_type", S), ("device_id", S),
                  ("operator_id", S), ("start_time", TS), ("end_time", TS), ("status", S),
                  ("result", S), ("notes", S), ("created_at", TS), ("updated_at", TS))
EXPERIMENT_DATA = _st(("id", S), ("experiment_id", S), ("sequence_number", I), ("current", D),
                      ("voltage", D), ("power", D), ("timestamp", TS), ("device_address", I),
                      ("device_type", S), ("temperature", D), ("humidity", D),
                      ("created_at", TS), ("updated_at", TS))
TEST_STANDARDS = _st(("id", S), ("standard_code", S), ("standard_name", S), ("test_type", S),
                     ("parameters", S), ("pass_criteria", S), ("created_at", TS), ("updated_at", TS))
FILES = _st(("id", S), ("file_name", S), ("file_path", S), ("file_size", L), ("file_type", S),
            ("experiment_id", S), ("uploaded_by", S), ("upload_time", TS), ("created_at", TS))
USER_PROFILES = _st(("id", S), ("full_name", S), ("role", S), ("department", S), ("phone", S),
                    ("created_at", TS), ("updated_at", TS))
OPERATION_LOGS = _st(("id", S), ("user_id", S), ("operation_type", S), ("operation_detail", S),
                     ("ip_address", S), ("created_at", TS))

TABLES = {
    "devices": DEVICES, "experiments": EXPERIMENTS, "experiment_data": EXPERIMENT_DATA,
    "test_standards": TEST_STANDARDS, "files": FILES, "user_profiles": USER_PROFILES,
    "operation_logs": OPERATION_LOGS,
}
