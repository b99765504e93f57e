"""What an update must show to enter a class: one table for the batch plan and the stream."""

from .. import constants as K


def rules(facts):
    """(class, condition) by falling priority, so the first that holds is the update's candidate.

    ``facts`` are columns, or the plain values of one update: foreign (origin neither known, kin nor
    valid), foreign_hosts (hosts behind it), dark (no session is active, enough are known), waited,
    leak (the path shows one), bogon, blackhole, hosts and all_hosts (with active, any sessions), and
    the running counts flaps, longer and path_changes.
    """
    hosts = facts["hosts"]
    return [
        (K.HIJACK, facts["foreign"] & (facts["foreign_hosts"] >= 5)),
        (K.OUTAGE, facts["dark"] & facts["waited"]),
        (K.ROUTE_LEAK, facts["leak"] & (hosts >= 15)),
        (K.BOGON, facts["bogon"]),
        (K.MINOR_LEAK, facts["leak"] & (hosts >= 7)),
        (K.DDOS, (hosts >= 3) & facts["blackhole"]),
        (K.FLAP, (facts["all_hosts"] >= 2) & (facts["flaps"] >= 3)),
        (K.PATH_HUNTING, (hosts >= 2) & (facts["longer"] >= 2) & (facts["path_changes"] >= 3)),
    ]
