"""String, address and path functions of the event model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: path parts that are sensitive, interpreters that count as install hooks, and commands
SENSITIVE = (".ssh/", ".aws/", "aws/credentials", ".env", ".npmrc", ".gitconfig", "/etc/passwd", "/etc/shadow", "/proc/self/environ", "id_rsa", "id_ed25519", "authorized_keys")
INTERPRETERS = ("sh", "bash", "node", "python")
MANAGERS = ("/npm", "/yarn", "/pnpm")
INSTALL_COMMANDS = ("install", "i", "ci", "add")


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether one of ``parts`` occurs, case-sensitively; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, (text.contains(p) for p in parts)), F.lit(False))


def is_sensitive(path: Column) -> Column:
    return contains_any(path, SENSITIVE)


def is_interpreter(comm: Column) -> Column:
    return F.coalesce(comm.isin(*INTERPRETERS), F.lit(False))


def is_package_manager(path: Column, own_name: str) -> Column:
    """A package manager's path that is not the product's own shim."""
    return contains_any(path, MANAGERS) & ~F.coalesce(path.contains(own_name), F.lit(False))


def is_install_command(command: Column) -> Column:
    return F.coalesce(command.isin(*INSTALL_COMMANDS), F.lit(False))


def dotted_quad(ip: Column, network_order: bool = False) -> Column:
    """An IPv4 number as text, most significant octet first; reversed for a number stored in network order on a little-endian machine."""
    shifts = (0, 8, 16, 24) if network_order else (24, 16, 8, 0)
    return F.concat_ws(".", *[F.shiftright(ip.cast("bigint"), s).bitwiseAND(255).cast("string") for s in shifts])


def swap_port(port: Column) -> Column:
    p = port.cast("bigint")
    return F.shiftleft(p.bitwiseAND(255), 8).bitwiseOR(F.shiftright(p, 8).bitwiseAND(255))


def c_string(text: Column, size: int) -> Column:
    """What a NUL-terminated buffer of ``size`` bytes keeps of ``text``."""
    return F.substring(F.substring_index(text, "\x00", 1), 1, size - 1)


def scaled(x: Column, precision: int) -> Column:
    return x.cast("double") / F.lit(float(precision))
