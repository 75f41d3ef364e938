"""Column functions: text, quantities, compositions, digit repair, replies, chunks."""
