"""Command line: python -m tidelog.inspect FILE.sst [--verify] [--list] ...; shows a run file's header and records."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime, timezone

from tidelog.errors import StoreError
from tidelog.sources.binary import DELETE, HEADER, decode_header, decode_run, verify_run


def shown(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "0x" + raw.hex()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("path")
    for flag in ("--verify", "--list", "--keys-only"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--offset", type=int, help="first byte to list from")
    p.add_argument("--limit", type=int, help="bytes to list")
    p.add_argument("--start-key")
    p.add_argument("--end-key")
    args, unknown = p.parse_known_args(argv)
    for x in unknown:
        print(f"Warning: Unrecognized option: {x}", file=sys.stderr)
    if not os.path.exists(args.path):
        print(f"Error: File does not exist: {args.path}", file=sys.stderr)
        return 1
    with open(args.path, "rb") as f:
        data = f.read()
    if len(data) < HEADER.size:
        print(f"Error: File is too small to be a valid SSTable (size: {len(data)} bytes).", file=sys.stderr)
        return 1
    try:
        head = decode_header(data)
    except StoreError as e:
        print(f"Error inspecting SSTable: {e}", file=sys.stderr)
        return 1
    created = datetime.fromtimestamp(head["created_time"] / 1000, timezone.utc).isoformat()
    print("--- SSTable Header ---")
    print(f"Magic: 0x{head['magic']:x}\nVersion: {head['version']}\nKey Count: {head['key_count']}")
    print(f"Index Offset: {head['index_offset']}\nData Offset: {head['data_offset']}")
    print(f"Created Time: {created} ({head['created_time']})\nChecksum: 0x{head['checksum']:x}")
    status = 0
    if args.verify:
        print("\n--- Integrity Check ---")
        seen = 0
        try:
            for _ in decode_run(data):
                seen += 1
            verify_run(data)
            print(f"Integrity Check: PASSED\nRecords scanned: {seen}")
        except StoreError as e:
            print(f"Corruption detected: {e}", file=sys.stderr)
            print("Integrity Check: FAILED")
            status = 1
    if args.list or args.keys_only:
        print("\n--- Data Listing ---")
        first = head["data_offset"] if args.offset is None else args.offset
        last = head["index_offset"] if args.limit is None else min(head["index_offset"], first + args.limit)
        start, end = (None if k is None else k.encode() for k in (args.start_key, args.end_key))
        listed = 0
        for at, op, key, value in decode_run(data, first):
            if at >= last or end is not None and key > end:
                break
            if start is not None and key < start:
                continue
            print(shown(key) if args.keys_only else f"{shown(key)} => {'[TOMBSTONE]' if op == DELETE else shown(value)}")
            listed += 1
        print(f"Total records listed: {listed}")
    return status


if __name__ == "__main__":
    sys.exit(main())
