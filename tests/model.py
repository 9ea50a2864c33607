"""A sequential model of the reference-counted table."""

from __future__ import annotations


def run(ops: list[tuple[int, str, str]]) -> list[dict]:
    table: dict[str, list[int]] = {}
    fresh, out = 0, []
    for seq, op, fp in ops:
        held = table.get(fp)
        count, lba, hit = (held[0], held[1], True) if held else (0, 0, False)
        if op == "WRITE2FREE":
            if held:
                held[0] += 1
            else:
                fresh += 1
                table[fp] = held = [1, fresh]
            count, lba = held
        elif op == "ERASEREF" and held:
            held[0] -= 1
            count = held[0]
            if not count:
                del table[fp]
        out.append({"seq": seq, "ref_count": count, "ssd_lba": lba, "hit": hit})
    return out
