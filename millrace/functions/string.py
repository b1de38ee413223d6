"""String functions. Positions and lengths count characters; NULL in gives NULL out but for concat and concat_ws."""

from .registry import define

define("left", "case when {1} < 0 then substr({0}, 1, greatest(length({0}) + {1}, 0)) else left({0}, {1}) end", 2)
define("right", "case when {1} < 0 then right({0}, greatest(length({0}) + {1}, 0)) else right({0}, {1}) end", 2)
define("substr", "substr({0}, greatest({1}, 1))", 2)
define("substr", "case when {2} < 0 then null else substr({0}, greatest({1}, 1), greatest(least({1} + {2}, length({0}) + 1) - greatest({1}, 1), 0)) end", 3)
define("substring", "substr({0}, greatest({1}, 1))", 2)
define("substring", "case when {2} < 0 then null else substr({0}, greatest({1}, 1), greatest(least({1} + {2}, length({0}) + 1) - greatest({1}, 1), 0)) end", 3)
_LOCATE = "case when {2} < 0 then 0 when length({1}) = 0 then case when greatest({2}, 1) <= length({0}) + 1 then greatest({2}, 1) else 0 end else locate({1}, {0}, greatest({2}, 1)) end"
define("locate", _LOCATE.replace("{2}", "1"), 2)
define("locate", _LOCATE, 3)
define("strpos", "case when length({1}) = 0 then if({0} is null, null, 1) else instr({0}, {1}) end", 2)
define("strposb", "case when length({1}) = 0 then if({0} is null, null, 1) when instr({0}, {1}) = 0 then 0 else octet_length(left({0}, instr({0}, {1}) - 1)) + 1 end", 2)
define("concat", "concat_ws('', {*})")
define("split_part", "case when {2} > size(split({0}, concat('\\\\Q', {1}, '\\\\E'), -1)) then null else split_part({0}, {1}, {2}) end", 3)
define("chr", "case when {0} > 0 and {0} <= 65525 then decode(unhex(lpad(hex({0}), 4, '0')), 'UTF-16BE') end", 1)
define("btrim", "trim({0})", 1)
define("btrim", "trim(both {1} from {0})", 2)
define("trim", "trim(both {1} from {0})", 2)
define("ltrim", "trim(leading {1} from {0})", 2)
define("rtrim", "trim(trailing {1} from {0})", 2)
define("char_length", "length({0})", 1)
define("character_length", "length({0})", 1)
define("lpad", "lpad({0}, {1}, ' ')", 2)
define("rpad", "rpad({0}, {1}, ' ')", 2)
define("quote_ident", "concat('\"', {0}, '\"')", 1)
define("to_bin", "bin({0})", 1)
define("to_hex", "case when {0} = 0 then repeat('0', if(typeof({0}) = 'bigint', 16, 8)) when {0} < 0 and typeof({0}) <> 'bigint' then lower(right(hex({0}), 8)) else lower(hex({0})) end", 1)
define("digest", "case lower({1}) when 'md5' then md5({0}) when 'sha1' then sha1({0}) when 'sha-1' then sha1({0}) when 'sha256' then sha2({0}, 256) when 'sha-256' then sha2({0}, 256) when 'sha384' then sha2({0}, 384) when 'sha-384' then sha2({0}, 384) when 'sha512' then sha2({0}, 512) when 'sha-512' then sha2({0}, 512) end", 2)
define("encode", "case lower({1}) when 'base64' then base64(encode({0}, 'UTF-8')) when 'hex' then lower(hex(encode({0}, 'UTF-8'))) end", 2)
define("decode", "case lower({1}) when 'base64' then decode(try_to_binary({0}, 'base64'), 'UTF-8') when 'hex' then decode(unhex({0}), 'UTF-8') end", 2)
define("find_in_set", "find_in_set({0}, {1})", 2)
define("ascii", "ascii({0})", 1)
define("initcap", "initcap({0})", 1)
