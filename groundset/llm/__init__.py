"""Operators for preparing training text: cleaning, duplicates, tokens, packing, shards, chats, archives."""
