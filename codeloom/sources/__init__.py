"""What codes are made of: files, blocks of files, and golden records."""
