"""Conditional and other functions."""

from .registry import define

define("coalesce", "coalesce({*})")
define("random", "cast(rand() * {0} as int)", 1)
define("date", "unix_millis(to_timestamp({0}, 'dd/MM/yyyy HH:mm:ss'))", 1)
