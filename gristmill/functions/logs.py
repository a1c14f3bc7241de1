"""Log lines of sixteen systems: their formats, severities and components."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published line formats of the systems; a field in angle brackets is a run without spaces unless SPACED.
FORMATS = {
    "HDFS": "<Date> <Time> <Pid> <Level> <Component>: <Content>",
    "Hadoop": "<Date> <Time> <Level> \\[<Process>\\] <Component>: <Content>",
    "Spark": "<Date> <Time> <Level> <Component>: <Content>",
    "Zookeeper": "<Date> <Time> - <Level>\\s+\\[<Node>:<Component>@<Id>\\] - <Content>",
    "OpenStack": "<Logrecord> <Date> <Time> <Pid> <Level> <Component> \\[<Address>\\] <Content>",
    "BGL": "<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>",
    "HPC": "<LogId> <Node> <Component> <State> <Time> <Flag> <Content>",
    "Thunderbird": "<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(?:\\[<Pid>\\])?: <Content>",
    "Windows": "<Date> <Time>, <Level>\\s+<Component>\\s+<Content>",
    "Linux": "<Month> <Date> <Time> <Level> <Component>(?:\\[<Pid>\\])?: <Content>",
    "Mac": "<Month>\\s+<Date> <Time> <User> <Component>\\[<Pid>\\](?: \\(<Address>\\))?: <Content>",
    "Android": "<Date> <Time>\\s+<Pid>\\s+<Tid> <Level> <Component>: <Content>",
    "HealthApp": "<Time>\\|<Component>\\|<Pid>\\|<Content>",
    "Apache": "\\[<Stamp>\\] \\[<Level>\\] <Content>",
    "OpenSSH": "<Date> <Day> <Time> <Component> sshd\\[<Pid>\\]: <Content>",
    "Proxifier": "\\[<Stamp>\\] <Component> - <Content>",
}
SPACED = {"Content": ".*", "Stamp": "[^\\]]*", "Process": "[^\\]]*", "Address": "[^\\]\\)]*", "Node": "[^:\\s]*", "Component": "[^\\s:\\[\\]@|]+", "Level": "[A-Za-z]+", "Time": "[^\\s|]+"}
#: Systems whose level field holds no severity.
NO_LEVEL = ("Linux",)
# Severities by name.
LEVELS = {"V": "DEBUG", "VERBOSE": "DEBUG", "D": "DEBUG", "DEBUG": "DEBUG", "TRACE": "DEBUG", "I": "INFO", "INFO": "INFO", "INFORMATION": "INFO", "N": "NOTICE", "NOTICE": "NOTICE",
          "W": "WARN", "WARN": "WARN", "WARNING": "WARN", "E": "ERROR", "ERROR": "ERROR", "ERR": "ERROR", "F": "FATAL", "FATAL": "FATAL", "CRIT": "FATAL", "CRITICAL": "FATAL",
          "ALERT": "FATAL", "EMERG": "FATAL", "PANIC": "FATAL"}


def pattern(system: str, field: str) -> str:
    """The system's format as a pattern whose one group is the field."""
    part = lambda m: (f"({SPACED.get(m[1], '\\S+')})" if m[1] == field else f"(?:{SPACED.get(m[1], '\\S+')})")
    return "^" + re.sub("<([A-Za-z]+)>", part, FORMATS[system]) + "$"


def parsed(system: Column, line: Column, field: str) -> Column:
    """A field of a line by its system's format; null where the line doesn't fit or the format has none."""
    out = F.lit(None).cast("string")
    for name, form in FORMATS.items():
        if f"<{field}>" in form and not (field == "Level" and name in NO_LEVEL):
            p = pattern(name, field)
            out = F.when((system == name) & F.regexp_like(line, F.lit(p)), F.regexp_extract(line, p, 1)).otherwise(out)
    return out


def severity(level: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair)), F.upper(level))
