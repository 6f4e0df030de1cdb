"""Relations that the operators read: books, layout lines, markdown, markup, stores and dimensions."""
