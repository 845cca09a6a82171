"""Ordered rule tables (first match wins) as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.text import first_match

# ---------------------------------------------------------------------------
# fixed values: level words of container lines, in order
LEVEL_WORDS = [
    (r"(?i)\b(FATAL|PANIC)\b", "FATAL"),
    (r"(?i)\b(ERROR|ERR)\b", "ERROR"),
    (r"(?i)\b(WARN(?:ING)?)\b", "WARN"),
    (r"(?i)\b(INFO)\b", "INFO"),
    (r"(?i)\b(DEBUG|DBG)\b", "DEBUG"),
    (r"(?i)\b TRACE \b", "TRACE"),
]

# fixed values: syslog severity patterns, in order
SEVERITY_WORDS = [
    (r"(?i)\bPANIC\b", "FATAL"),
    (r"(?i)\bFATAL\b", "FATAL"),
    (r"(?i)level=(?:error|crit|fatal)", "ERROR"),
    (r"(?i)\bERROR\b", "ERROR"),
    (r"(?i)level=warning", "WARN"),
    (r"(?i)\bWARNING\b", "WARN"),
    (r"(?i)level=notice", "NOTICE"),
    (r"(?i)level=debug", "DEBUG"),
    (r"(?i)\bDEBUG\b", "DEBUG"),
    (r"(?i)level=info", "INFO"),
]
SEVERITY_FIELD = (
    r"(?i)(?:^|[\s;])(?:level|lvl|severity)\s*=\s*"
    r"(debug|info|notice|warning|warn|error|err|crit|fatal|panic)"
)

# fixed values: texts that mark a failed authentication (lower case), and one pattern
AUTH_FAILURE = ["authentication failure", "invalid user", "not valid", "refused", "failed", "unauthorized"]
AUTH_CLOSED = r"(?i)connection closed.*preauth"
SOURCE_IP = r"(?:(?:from|for|client)\s+)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
TARGET_USER = r"(?:user|from)\s+(\S+)"

# fixed values: service categories and the words found in their process names
SERVICE_CATEGORIES = {
    "kernel": ["kernel", "i915", "drm"],
    "system": ["systemd", "systemd-logind", "systemd-sysusers", "systemd-modules-load",
               "systemd-journald", "systemd-resolved", "systemd-timesyncd",
               "systemd-tmpfiles", "udevd", "ModemManager"],
    "network": ["NetworkManager", "networkd", "wpa_supplicant", "dhclient", "polkitd"],
    "security": ["sshd", "sudo", "pam_unix", "pam_systemd", "fwupd"],
    "cron": ["CRON", "atd", "anacron"],
    "mail": ["postfix", "sendmail"],
    "package": ["PackageKit", "apt", "dpkg", "unattended-upgrades"],
    "monitoring": ["newrelic", "prometheus", "grafana", "node_exporter", "telegraf",
                   "amazon-ssm-agent"],
    "desktop": ["gnome-shell", "gnome-session", "gdm", "Xwayland", "mutter",
                "gjs", "Xorg", "xdg-desktop-portal"],
}

# fixed values: words that open a kernel trace (lower case)
TRACE_START = ["warning:", "bug:", "call trace:", "---[ cut here ]", "modules linked in:", "rip:", "code:",
               "hardware name:", "tainted:", "workqueue:"]

# fixed values: anomaly type, text the pattern cannot match without (lower case),
# pattern, description, in order
ANOMALIES = [
    ("kernel_warning", "warning:", r"\bWARNING:.*drivers/", "Kernel driver warning"),
    ("kernel_warning", "drm_warn_on", r"drm_WARN_ON", "DRM assertion failure"),
    ("kernel_warning", "tainted:", r"\bTainted:\s*\[W\]", "Kernel tainted with WARN flag"),
    ("kernel_bug", "bug:", r"\bBUG:", "Kernel BUG triggered"),
    ("kernel_oops", "rip:", r"\bRIP:\s", "Kernel RIP (possible oops)"),
    ("service_failure", "systemd[1]", r"systemd\[1\].*\bFailed\b", "systemd service failure"),
    ("service_failure", "exited with status", r"exited with status [1-9]", "Process exited with error status"),
    ("service_crash_loop", "deactivated successfully", r"systemd\[1\].*Deactivated successfully",
     "Service deactivated (watch for restart loop)"),
    ("display_server", "exited unexpectedly", r"Xwayland.*exited unexpectedly", "Xwayland crash"),
    ("display_server", "assertion", r"GDM.*assertion.*failed", "GDM assertion failure"),
    ("display_server", "assertion", r"gnome-shell.*assertion.*failed", "GNOME Shell assertion failure"),
    ("display_server", "unable to register client", r"Unable to register client",
     "GNOME session registration failure"),
    ("application_error", "glib-", r"GLib-\w+\s*\*\*", "GLib critical error"),
    ("application_error", "assertion", r"assertion\s+.*failed", "Assertion failure"),
    ("application_error", "error", r"\bError\b.*failed", "Application error"),
    ("network_issue", "time", r"(?:timed?\s*out|timeout)", "Network/service timeout"),
    ("network_issue", "re", r"(?:unreachable|refused|reset)", "Network unreachable/refused"),
    ("network_issue", "carrier", r"carrier (?:error|lost)", "Network carrier issue"),
    ("security", "failed password", r"Failed password", "SSH failed password"),
    ("security", "authentication failure", r"authentication failure", "Authentication failure"),
    ("security", "invalid user", r"invalid user", "Invalid user login attempt"),
    ("security", "denied", r"(?:permission|access) denied", "Permission/access denied"),
    ("security", "not in sudoers", r"sudo:.*NOT in sudoers", "Unauthorized sudo attempt"),
    ("hardware", "i915", r"i915.*WARN", "Intel GPU driver warning"),
    ("hardware", "timeout waiting for phy", r"timeout waiting for PHY", "PHY ready timeout"),
    ("hardware", "mce", r"MCE", "Machine Check Exception"),
    ("hardware", "thermal", r"thermal", "Thermal event"),
    ("livepatch", "livepatch", r"livepatch.*failed", "Livepatch update failure"),
    ("livepatch", "livepatch", r"POST request.*livepatch", "Livepatch API failure"),
    ("oom", "out of memory", r"out of memory", "Out of memory"),
    ("oom", "killed process", r"killed process", "OOM killer invoked"),
    ("filesystem", "i/o error", r"I/O error", "Disk I/O error"),
    ("filesystem", "ext4", r"ext4.*error", "ext4 filesystem error"),
    ("filesystem", "xfs", r"xfs.*error", "XFS filesystem error"),
]

# fixed values: severity ranks
WEB_LEVEL_RANK = {"emerg": 0, "alert": 1, "crit": 2, "error": 3, "warn": 4,
                  "notice": 5, "info": 6, "debug": 7}
API_LEVEL_RANK = {"trace": 0, "debug": 1, "info": 2, "warn": 3, "warning": 3,
                  "error": 4, "fatal": 5, "critical": 5}
# ---------------------------------------------------------------------------


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Result of the first pattern found in the text, else NULL.

    Neighbouring rules with one result are tested as one alternation.
    """
    merged: list[tuple[list[str], str]] = []
    for pattern, result in rules:
        if merged and merged[-1][1] == result:
            merged[-1][0].append(pattern)
        else:
            merged.append(([pattern], result))
    out = None
    for patterns, result in merged:
        cond = text.rlike("|".join(patterns))
        out = F.when(cond, result) if out is None else out.when(cond, result)
    return out


def level_from_words(text: Column, with_trace: bool = True) -> Column:
    rules = LEVEL_WORDS if with_trace else LEVEL_WORDS[:-1]
    return F.coalesce(first_rule(text, rules), F.lit("UNKNOWN"))


def any_text(low: Column, texts: list[str]) -> Column:
    """Whether a lower-cased text holds any of the given texts (plain substring search, no regex)."""
    out = None
    for t in texts:
        hit = F.contains(low, F.lit(t))
        out = hit if out is None else out | hit
    return out


def syslog_severity(message: Column, low: Column) -> Column:
    """Severity of a syslog message; INFO when nothing in it names one.

    ``low`` is the message in lower case. Substring tests for the level words
    come first, since most messages carry none of them.
    """
    named = F.upper(first_match(message, SEVERITY_FIELD))
    field = F.when(named == "ERR", "ERROR").otherwise(named)
    # fixed values: a text without any of these has no severity word
    some_word = any_text(low, ["panic", "fatal", "level", "error", "warn", "debug", "lvl", "severity"])
    return F.when(some_word, F.coalesce(first_rule(message, SEVERITY_WORDS), field, F.lit("INFO"))).otherwise("INFO")


def service_category(process: Column) -> Column:
    low = F.lower(process)
    out = None
    for category, words in SERVICE_CATEGORIES.items():
        cond = any_text(low, [w.lower() for w in words])
        out = F.when(cond, category) if out is None else out.when(cond, category)
    return out.otherwise("other")


def is_auth_failure(message: Column, low: Column) -> Column:
    closed = F.contains(low, F.lit("connection closed")) & message.rlike(AUTH_CLOSED)
    return any_text(low, AUTH_FAILURE) | closed


def anomaly_rule(message: Column, low: Column) -> Column:
    """Position (from 0) of the first anomaly pattern found in the message, else NULL.

    A substring test stands before each pattern: it is far cheaper than the
    regex and rules out nearly every line.
    """
    out = None
    for i, (_, needs, pattern, _) in enumerate(ANOMALIES):
        cond = F.contains(low, F.lit(needs)) & message.rlike("(?i)" + pattern)
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out


def anomaly_type(rule: Column, message: Column, severity: Column) -> Column:
    types = F.array(*[F.lit(t) for t, _, _, _ in ANOMALIES])
    generic = (
        F.when(severity == "ERROR", "generic_error")
        .when((severity == "WARN") & ~message.startswith("level="), "generic_warning")
    )
    return F.when(severity == "FATAL", "fatal_error").otherwise(F.coalesce(F.get(types, rule), generic))


def anomaly_detail(rule: Column, message: Column, process: Column, severity: Column) -> Column:
    texts = F.array(*[F.lit(d) for _, _, _, d in ANOMALIES])
    head = F.left(message, F.lit(120))
    generic = (
        F.when(severity == "ERROR", F.concat(F.lit("Error from "), process, F.lit(": "), head))
        .when((severity == "WARN") & ~message.startswith("level="),
              F.concat(F.lit("Warning from "), process, F.lit(": "), head))
    )
    return F.when(severity == "FATAL", F.concat(F.lit("Fatal: "), head)).otherwise(
        F.coalesce(F.get(texts, rule), generic, F.lit("")))


def rank_of(level: Column, ranks: dict[str, int], default: int) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.coalesce(F.try_element_at(table, level), F.lit(default))


def lock_class(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(F.contains(low, F.lit("deadlock")), "deadlock")
        .when(F.contains(low, F.lit("timeout")), "timeout")
        .when(F.contains(low, F.lit("waiting")), "wait")
        .otherwise("other")
    )
