"""Classification of stack frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Symbol patterns by frame kind, tried in this order; the first block applies to names without "::".
C_SYMBOLS = (
    ("libc", r"^(__GI_|__libc_|__pthread_|__clone|start_thread|__poll|__epoll|__futex|malloc|free|mmap|munmap|brk|sbrk)"),
    ("allocator", r"^(je_|arena_|tcache_|extent_|large_|slab_|jemalloc)"),
    ("allocator", r"^(mi_|_mi_|mi_heap_|mimalloc)"),
    ("kernel", r"^(__|do_|sys_|entry_|exit_to|irq_|page_|rcu_|synchronize_)"),
    ("kernel", r"^(schedule|expand_fd|expand_files|alloc_fd|ep_poll|ep_send|futex_|sock_|inet_|tcp_|vfs_|filp_|fd_install|ksys_|fput|fget)"),
)
PATH_SYMBOLS = (
    ("runtime", r"^<?tokio::runtime::(scheduler|task|blocking|context|coop)"),
    ("runtime", r"^std::(panicking|sys|thread)::"),
    ("runtime", r"^<std::(sys|thread)::"),
    ("runtime", r"^core::(ops::function|panicking)::"),
)
PLUMBING = r"^(__schedule|schedule$|schedule_timeout|do_syscall_64|entry_SYSCALL|__x64_sys_|__sys_|__wait_for_common|__wait_rcu_gp)"


def frame_kind(symbol: Column) -> Column:
    """kernel, libc, allocator, runtime, app or unknown."""
    kind = F.when(symbol.isNull() | (symbol == "") | F.startswith(symbol, F.lit("0x")), "unknown")
    plain = ~F.contains(symbol, F.lit("::"))
    for name, pattern in C_SYMBOLS:
        kind = kind.when(plain & F.rlike(symbol, F.lit(pattern)), name)
    for name, pattern in PATH_SYMBOLS:
        kind = kind.when(F.rlike(symbol, F.lit(pattern)), name)
    return kind.otherwise("app")


def diagnose_stack(frames: Column) -> dict[str, Column]:
    """Of a leaf-to-root stack, up to its first application frame: the system call (first libc frame), the blocker
    (first kernel frame that is not generic plumbing) and the trigger (that application frame)."""
    app = F.array_position(F.transform(frames, frame_kind), F.lit("app")).cast("int")
    upto = F.when(app > 0, F.slice(frames, F.lit(1), app)).otherwise(frames)
    libc = F.filter(upto, lambda f: frame_kind(f) == "libc")
    kernel = F.filter(upto, lambda f: (frame_kind(f) == "kernel") & ~F.rlike(f, F.lit(PLUMBING)))
    return {"syscall": F.get(libc, F.lit(0)), "blocker": F.get(kernel, F.lit(0)), "trigger": F.when(app > 0, F.element_at(frames, app))}


def blocking_category(leaf: Column) -> Column:
    has = lambda *words: _any([F.contains(leaf, F.lit(w)) for w in words])
    return (F.when(has("lock", "mutex"), "lock").when(has("epoll", "poll"), "poll")
            .when(has("write", "read", "recv", "send"), "io").when(has("syscall"), "syscall").otherwise("other"))


def _any(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def shared_images(symbols: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The image of every process (keys, image) and each image's symbols once (image, addr, inline_depth, symbol_name).

    An image is named by its content: processes whose symbols are the same, in whatever order and number of copies, share one. The name is
    made of sums of two hashes, so no table is gathered or sorted.
    """
    rows = symbols.select(*keys, "addr", F.coalesce("inline_depth", F.lit(0)).alias("inline_depth"), "symbol_name")
    rows = rows.groupBy(*keys, "addr", "inline_depth").agg(F.min("symbol_name").alias("symbol_name"))
    content = ("addr", "inline_depth", "symbol_name")
    total = lambda tag: F.sum(F.xxhash64(F.lit(tag), *content).cast("decimal(38,0)")).cast("string")
    images = rows.groupBy(*keys).agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total("a"), total("b")), 256).alias("image"))
    owner = images.groupBy("image").agg(F.min(F.struct(*keys)).alias("k")).select("image", *[F.col(f"k.{k}").alias(k) for k in keys])
    return images, rows.join(owner, list(keys)).select("image", *content)


def symbolize(samples: DataFrame, symbols: DataFrame, id_col: str = "stack_id", keys: Sequence[str] = ()) -> DataFrame:
    """Address stacks to frame stacks, leaf to root: inlined callees come innermost first, an unknown address stays
    as hex text. Each distinct stack is resolved once; ``symbols``: addr, inline_depth, symbol_name.

    With ``keys`` (those of a process) an address means what its own process's image has there: both sides carry the keys, stacks of
    processes with one image are resolved once, and the result has the keys too. An address listed twice at one depth counts once.
    """
    keys = list(keys)
    if keys:
        images, table = shared_images(symbols, keys)
        own = samples.select(*keys, id_col, "callchain").join(images, keys, "left")
        groups = ["image", id_col]
    else:
        own, table, groups = samples, symbols.groupBy("addr", "inline_depth").agg(F.min("symbol_name").alias("symbol_name")), [id_col]
    stacks = own.select(*groups, "callchain").distinct()
    addrs = stacks.select(*groups, "callchain", F.posexplode("callchain").alias("pos", "addr"))
    hit = addrs.join(table, ["image", "addr"] if keys else ["addr"], "left")
    text = F.coalesce("symbol_name", F.concat(F.lit("0x"), F.lower(F.hex("addr"))))
    item = F.struct("pos", (-F.coalesce("inline_depth", F.lit(0))).alias("order"), text.alias("frame"))
    # an id may stand for different addresses in different processes of one image
    found = hit.groupBy(*groups, "callchain").agg(F.array_sort(F.collect_list(item)).alias("f")).select(
        *groups, "callchain", F.transform("f", lambda x: x["frame"]).alias("frames"))
    if not keys:
        return found.select(id_col, "frames")
    same = own.select(*keys, *groups, "callchain").distinct().alias("o").join(
        found.alias("f"), F.expr(f"o.image <=> f.image AND o.`{id_col}` = f.`{id_col}` AND o.callchain = f.callchain"))
    return same.select(*[F.col(f"o.{k}").alias(k) for k in keys], F.col(f"o.{id_col}").alias(id_col), "f.frames")
