"""quillmill.operators"""
