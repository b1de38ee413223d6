"""Mathematical functions. Division and remainder by zero give NULL; round, ceil and floor give INT8."""

from .registry import define

define("div", "{0} div nullif({1}, 0)", 2)
define("mod", "try_mod({0}, {1})", 2)
define("round", "cast(round({0}) as bigint)", 1)
define("round", "cast(round({0}, {1}) as double)", 2)
define("ceil", "cast(ceil({0}) as bigint)", 1)
define("ceiling", "cast(ceil({0}) as bigint)", 1)
define("floor", "cast(floor({0}) as bigint)", 1)
define("sign", "signum(cast({0} as double))", 1)
define("pow", "power({0}, {1})", 2)
for _name in ("abs", "acos", "asin", "atan", "cbrt", "cos", "degrees", "exp", "radians", "sin", "sqrt", "tan"):
    define(_name, f"{_name}({{0}})", 1)
define("atan2", "atan2({0}, {1})", 2)
define("pi", "pi()", 0)
