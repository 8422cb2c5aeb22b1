"""Steps of a training-data pipeline over documents, pages and vectors, each by one named method.

``pii``          personal data: semi-Markov conditional random field
``quality``      document quality: linear-chain conditional random field over lines
``langid``       language: averaged hashed subword embeddings, linear softmax
``hamming``      exact top-k search over binary codes: incremental multi-index hashing
``sitetree``     main text of web pages: site style tree
``urlvocab``     page addresses: weighted vocabulary and Aho-Corasick matching
``wordrules``    quality rules and a hashed n-gram logistic regression
``packing``      token sequences: cost-balanced packing
``neardup``      near duplicates: fast similarity sketching, banding, exact verification
``bpe``          byte-pair encoding as a deterministic automaton
``align``        alignment of two tokenizations: divide and conquer at shared cuts
``exact``        exact duplicates: deterministic block naming
``runs``         periodic runs of words: suffix automaton with link-cut access
``queries``      the registered queries and their SQL
"""
