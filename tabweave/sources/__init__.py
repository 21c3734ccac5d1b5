"""Where tables come from: files, databases, logs; and named resources."""
