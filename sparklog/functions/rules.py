"""Fixed values that results depend on.

FIXED VALUES — these word lists, weights, thresholds and lookup tables must keep
exactly these entries, in this order, for the scores, severities and mappings to
come out right.  They are data, not code: every operator reads them from here (or
from a DataFrame built from them that a caller may replace).
"""

from __future__ import annotations

# ---------------------------------------------------------------- features (X*)
# keyword -> risk weight used by the ``keyword_risk`` feature (max of contained words)
FEATURE_RISK_KEYWORDS = [
    ("failed password", 0.95), ("authentication failed", 0.95),
    ("invalid user", 0.90), ("sasl login", 0.88), ("failed mfa", 0.97),
    ("suspicious command", 0.98), ("unauthorized", 0.93),
    ("brute", 0.96), ("exploit", 0.99), ("rootkit", 1.0),
    ("failed", 0.65), ("error", 0.55), ("warning", 0.45),
    ("denied", 0.70), ("rejected", 0.68), ("blocked", 0.60),
    ("sudo", 0.55), ("root", 0.52), ("admin", 0.50),
    ("disconnect", 0.40), ("connect from unknown", 0.65),
    ("accepted publickey", 0.25), ("started session", 0.15),
    ("container started", 0.20), ("user login succeeded", 0.20),
]

# lower-cased source -> risk; anything else 0.30
FEATURE_SOURCE_RISK = [
    ("sshd", 0.50), ("sudo", 0.60), ("kernel", 0.55),
    ("auditd", 0.55), ("postfix", 0.45), ("nginx", 0.40),
    ("cron", 0.15), ("systemd", 0.15), ("dockerd", 0.20),
    ("app-worker", 0.45),
]
FEATURE_SOURCE_RISK_DEFAULT = 0.30

FAILURE_TOKENS = ["failed", "failure", "denied", "rejected"]
PRIVILEGE_TOKENS = ["sudo", "root", "admin", "privilege"]
AUTH_TOKENS = ["ssh", "publickey", "password", "login"]

# Java-regex forms of the IP and port patterns
IP_PATTERN = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
PORT_PATTERN = r"\bport\s+\d+\b"

# exact-case severity -> level; anything else (NULL included) 1
FEATURE_SEVERITY_LEVEL = [
    ("CRITICAL", 5), ("HIGH", 4), ("ERROR", 4),
    ("MEDIUM", 3), ("WARN", 3), ("WARNING", 3),
    ("LOW", 2), ("INFO", 1), ("DEBUG", 0),
]
FEATURE_SEVERITY_DEFAULT = 1

FEATURE_NAMES = [
    "hour_of_day", "day_of_week", "after_hours",
    "severity_level", "source_encoded", "source_risk",
    "event_type_encoded", "message_length", "word_count",
    "keyword_risk", "event_id_hash",
    "has_username", "has_hostname", "has_process", "process_id_norm",
    "has_failure_signal", "has_privilege_signal", "has_auth_signal",
    "has_ip_address", "has_port_number",
]

# ------------------------------------------------------- keyword engine
SUSPICIOUS_KEYWORDS = [
    ("failed password", 0.95),
    ("authentication failed", 0.95),
    ("invalid user", 0.95),
    ("sasl login authentication failed", 0.95),
    ("suspicious command", 0.98),
    ("failed mfa", 0.97),
    ("unauthorized", 0.93),
    ("rootkit", 1.0),
    ("malware", 1.0),
    ("failed", 0.80),
    ("error", 0.75),
    ("disconnect", 0.72),
    ("warning", 0.70),
    ("denied", 0.78),
    ("reject", 0.76),
    ("blocked", 0.74),
    ("sudo", 0.60),
    ("root", 0.62),
    ("admin", 0.58),
    ("privilege", 0.65),
    ("connect from unknown", 0.68),
    ("accepted publickey", 0.35),
    ("started session", 0.25),
    ("cmd", 0.30),
    ("container started", 0.28),
    ("user login succeeded", 0.30),
]

# source substring -> weight, applied in this order: score = max(score, w) * 0.9
SOURCE_SEVERITY_RULES = [
    ("kernel", 0.65),
    ("auditd", 0.60),
    ("sshd", 0.50),
    ("sudo", 0.65),
    ("cron", 0.20),
    ("systemd", 0.20),
    ("dockerd", 0.25),
    ("nginx", 0.40),
    ("postfix", 0.45),
    ("app-worker", 0.50),
]
SOURCE_RULE_DAMPING = 0.9

# upper(coalesce(severity,'INFO')) -> base score; anything else 0.25
KEYWORD_SEVERITY_BASE = [
    ("CRITICAL", 0.85),
    ("HIGH", 0.70),
    ("MEDIUM", 0.50),
    ("ERROR", 0.70),
    ("WARNING", 0.45),
    ("WARN", 0.45),
    ("INFO", 0.25),
    ("DEBUG", 0.10),
]
KEYWORD_SEVERITY_DEFAULT = 0.25

# ------------------------------------------------------------- ensemble
ENSEMBLE_WEIGHTS = [
    ("isolation_forest", 0.35),
    ("one_class_svm", 0.25),
    ("statistical", 0.20),
    ("keyword", 0.20),
]
SINGLE_MODEL_WEIGHT = 0.75
SINGLE_KEYWORD_WEIGHT = 0.25
ZSCORE_THRESHOLD = 3.0
ZERO_STD_REPLACEMENT = 1e-10
REDISTRIBUTE_STEEPNESS = 6.0
REDISTRIBUTE_FLOOR = 0.1
REDISTRIBUTE_SPAN = 0.89
CONSTANT_SPREAD = (0.1, 0.9)
PREDICTION_PERCENTILE = 0.85
DEFAULT_ACCEPT_THRESHOLD = 0.70
ISOLATION_TREES = 100
ISOLATION_SAMPLE = 256
RANDOM_SEED = 42
SVM_GAP = 1e-3
SVM_MARGIN_BINS = 32
SVM_SAMPLE = 32768
SVM_DIRECTIONS = 24
AUTO_STATISTICAL_BELOW = 75
AUTO_FOREST_ABOVE = 100000

# ---------------------------------------------------------- severity scales (G*)
# stored anomaly severity (G01) and technique severity
STORED_SEVERITY_SCALE = [(0.90, "CRITICAL"), (0.75, "HIGH"), (0.55, "MEDIUM")]
STORED_SEVERITY_ELSE = "LOW"
# summary / threat severity
SUMMARY_SEVERITY_SCALE = [(0.95, "CRITICAL"), (0.85, "HIGH"), (0.70, "MEDIUM")]
SUMMARY_SEVERITY_ELSE = "LOW"
# contextual threat score level (G03), applied to score/100
THREAT_LEVEL_SCALE = [(0.95, "CRITICAL"), (0.85, "HIGH"), (0.70, "MEDIUM"), (0.50, "LOW")]
THREAT_LEVEL_ELSE = "INFO"
THREAT_SEVERITY_BOOST = 1.2
THREAT_SEVERITY_BOOST_LEVELS = ["CRITICAL", "HIGH", "ERROR"]
THREAT_EVENT_BOOST = 1.15
THREAT_EVENT_TOKENS = ["failed", "error", "unauthorized"]
THREAT_AFTER_HOURS_BOOST = 1.1
# stream severity
STREAM_SEVERITY_SCALE = [(0.90, "CRITICAL"), (0.72, "HIGH"), (0.55, "MEDIUM"), (0.35, "LOW")]
STREAM_SEVERITY_ELSE = "INFO"
# ordered severity scale of filters
SEVERITY_RANK = [("INFO", 0), ("LOW", 1), ("MEDIUM", 2), ("HIGH", 3), ("CRITICAL", 4)]
# report risk index weights
RISK_INDEX_WEIGHTS = [("LOW", 1), ("MEDIUM", 3), ("HIGH", 6), ("CRITICAL", 10)]
RISK_INDEX_LEVELS = [(70, "HIGH"), (40, "MEDIUM")]
RISK_INDEX_ELSE = "LOW"
# node threat level by anomaly rate
NODE_RATE_LEVELS = [(0.20, "CRITICAL"), (0.10, "HIGH"), (0.05, "MEDIUM")]
# frontend default score by severity
DEFAULT_SCORE_BY_SEVERITY = [("CRITICAL", 0.95), ("HIGH", 0.82), ("MEDIUM", 0.66)]
DEFAULT_SCORE_ELSE = 0.42
# threat risk score weights
THREAT_RISK_WEIGHTS = [("CRITICAL", 1.0), ("HIGH", 0.75), ("MEDIUM", 0.5), ("LOW", 0.25), ("INFO", 0.1)]
THREAT_RISK_DEFAULT_WEIGHT = 0.5

# --------------------------------------------------------------- ATT&CK
# Windows event id -> technique; the id 4720 appears twice and the later entry wins
EVENT_TECHNIQUE_RULES = [
    ("4624", "T1078"),
    ("4625", "T1110"),
    ("4672", "T1078.002"),
    ("4720", "T1136.001"),
    ("4732", "T1098"),
    ("4688", "T1059"),
    ("4698", "T1053.005"),
    ("4720", "T1136"),
    ("5140", "T1021.002"),
    ("7045", "T1543.003"),
]

# keyword contained in lower(message) + ' ' + lower(event_type) -> technique, in rule order
KEYWORD_TECHNIQUE_RULES = [
    ("powershell", "T1059.001"),
    ("cmd.exe", "T1059.003"),
    ("wmic", "T1047"),
    ("mimikatz", "T1003"),
    ("credential", "T1003"),
    ("password", "T1003"),
    ("registry", "T1112"),
    ("scheduled task", "T1053"),
    ("service", "T1543"),
    ("remote desktop", "T1021.001"),
    ("ssh", "T1021.004"),
    ("lateral movement", "T1021"),
    ("privilege escalation", "T1068"),
    ("persistence", "T1546"),
]

# ------------------------------------------------------ threat classifier
WINDOWS_THREAT_CATEGORIES = [
    ("4625", "unauthorized_access"),
    ("4672", "privilege_escalation"),
    ("4720", "persistence"),
    ("4732", "privilege_escalation"),
    ("4688", "command_execution"),
    ("5140", "lateral_movement"),
    ("7045", "persistence"),
]
THREAT_KEYWORD_GROUPS = [
    ("unauthorized_access", ["unauthorized", "failed login", "access denied", "invalid credentials"]),
    ("privilege_escalation", ["privilege", "administrator", "sudo", "elevation", "root"]),
    ("command_execution", ["powershell", "cmd.exe", "bash", "script", "execute"]),
    ("malware_activity", ["virus", "malware", "trojan", "ransomware", "suspicious"]),
    ("data_exfiltration", ["exfiltration", "data transfer", "upload", "copy"]),
]
THREAT_DESCRIPTION_CHARS = 200

# ------------------------------------------------------------------ parsers (P*)
SYSLOG_SEVERITY = [
    (0, "CRITICAL"), (1, "CRITICAL"), (2, "CRITICAL"), (3, "HIGH"),
    (4, "MEDIUM"), (5, "INFO"), (6, "INFO"), (7, "INFO"),
]
WINDOWS_EVENT_TYPES = [
    ("4624", "Account Logon"),
    ("4625", "Failed Logon"),
    ("4634", "Account Logoff"),
    ("4672", "Special Privileges Assigned"),
    ("4720", "User Account Created"),
    ("4726", "User Account Deleted"),
    ("4732", "Member Added to Security Group"),
    ("4733", "Member Removed from Security Group"),
    ("4688", "Process Created"),
    ("4689", "Process Terminated"),
    ("5140", "Network Share Accessed"),
    ("5145", "Network Share Checked"),
    ("1", "Application Error"),
    ("1000", "Application Error"),
    ("7045", "Service Installed"),
]
WINDOWS_LEVELS = [
    ("0", "INFO"), ("1", "CRITICAL"), ("2", "HIGH"),
    ("3", "MEDIUM"), ("4", "INFO"), ("5", "INFO"),
]

# alias keys of structured records, first non-blank wins
TS_KEYS = ["timestamp", "time", "ts", "@timestamp", "datetime", "date"]
MSG_KEYS = ["message", "msg", "log", "event", "description"]
SRC_KEYS = ["source", "service", "app", "application", "logger"]
SEV_KEYS = ["severity", "level", "log_level", "priority"]
HOST_KEYS = ["hostname", "host", "computer"]
USER_KEYS = ["username", "user", "account"]
EVENT_KEYS = ["event_type", "event", "type", "category"]
FALLBACK_MESSAGE_PAIRS = 8

# message-token severity inference (P13), first group that matches
INFERRED_SEVERITY = [
    ("CRITICAL", ["critical", "panic", "fatal"]),
    ("HIGH", ["error", "failed", "denied", "exception"]),
    ("MEDIUM", ["warn", "warning"]),
]
INFERRED_SEVERITY_ELSE = "LOW"

# length caps
CAP_FIELD = 255
CAP_MESSAGE = 4000
CAP_RAW = 8000
CAP_SEVERITY = 32
CAP_HUB_MESSAGE = 500
CAP_REPORT_MESSAGE = 200

# --------------------------------------------------------------- stream
QUICK_BASE = 0.20
QUICK_TIERS = [
    (0.95, ["failed password", "authentication failed", "invalid user",
            "sasl login", "brute", "exploit", "rootkit", "malware"]),
    (0.72, ["failed", "failure", "denied", "rejected", "error",
            "refused", "blocked", "unauthorized"]),
    (0.55, ["sudo", "root", "admin", "privilege", "escalat",
            "warning", "warn", "connect from unknown"]),
    (0.25, ["accepted", "started", "success", "opened"]),
]
QUICK_AFTER_HOURS_BONUS = 0.10
STREAM_ANOMALY_SCORE = 0.70
STREAM_PERSIST_SCORE = 0.55
STREAM_BUFFER = 1000
METRIC_RING = 3600

# ------------------------------------------------------------- devices
USB_CLASS_CODES = [
    ("00", "unknown"),
    ("01", "audio"),
    ("02", "network"),
    ("03", "hid"),
    ("06", "camera"),
    ("07", "printer"),
    ("08", "storage"),
    ("0a", "network"),
    ("e0", "network"),
    ("ef", "smartphone"),
    ("ff", "unknown"),
]
VENDOR_NAMES = [
    ("0781", "SanDisk"),
    ("058f", "Alcor (Generic USB)"),
    ("13fe", "Kingston"),
    ("0951", "Kingston DataTraveler"),
    ("8564", "Transcend"),
    ("14cd", "Super Top"),
    ("05ac", "Apple"),
    ("18d1", "Google (Android)"),
    ("0e8d", "MediaTek (Android)"),
    ("2717", "Xiaomi"),
    ("04e8", "Samsung"),
    ("0bb4", "HTC"),
    ("12d1", "Huawei"),
    ("046d", "Logitech"),
    ("045e", "Microsoft"),
    ("04f2", "Chicony"),
    ("0bda", "Realtek (USB Network)"),
    ("0b95", "ASIX (USB Ethernet)"),
    ("0403", "FTDI (USB-Serial)"),
    ("04d8", "Microchip"),
    ("0d8c", "C-Media (USB Audio)"),
    ("08bb", "Texas Instruments (Audio)"),
    ("1a86", "QinHeng (USB-Serial)"),
]
# name tokens, first class whose token is contained in lower(name)
DEVICE_NAME_CLASSES = [
    ("storage", ["storage", "flash", "disk", "drive", "card", "pendrive"]),
    ("audio", ["audio", "headphone", "headset", "speaker", "microphone", "sound"]),
    ("hid", ["keyboard", "mouse", "hid", "input"]),
    ("network", ["network", "ethernet", "wifi", "wlan", "adapter"]),
    ("camera", ["camera", "webcam", "imaging"]),
    ("smartphone", ["android", "iphone", "phone", "mtp", "adb"]),
    ("printer", ["print"]),
]
# vendor id groups, checked after the name tokens
DEVICE_VENDOR_CLASSES = [
    ("smartphone", ["18d1", "0e8d", "2717", "04e8", "0bb4", "12d1", "05ac"]),
    ("storage", ["0781", "058f", "13fe", "0951", "8564", "14cd"]),
    ("audio", ["0d8c", "08bb"]),
    ("network", ["0bda", "0b95"]),
]
SAFE_VENDOR_IDS = ["046d", "045e", "04f2", "0461", "04b3", "413c", "05ac", "0b05"]
RISKY_DEVICE_CLASSES = ["storage", "network", "smartphone"]
